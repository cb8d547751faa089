"""Clusters of mutually similar vectors by Markov clustering (problem 2).

Flow over a graph of all vectors and their neighbours would cut large round clusters to pieces, so the graph is first made coarser, as multilevel Markov clustering does: its nodes are landmarks,
each standing for the vectors nearest to it. Landmarks are drawn in passes over all vectors, fourfold more each time and the farther a vector lies from those before the likelier, until they no
longer come much nearer to the vectors; then groups of vectors that still lie apart get landmarks too. So their number follows the clusters there are; it is no constant. Two landmarks are as
similar as they lie near beside the spread of their vectors, or as many vectors lie between them. The flow of this graph is expanded by distributed sparse squaring, inflated and pruned until it
rests; attractor rows define the clusters, every vector goes with its landmark unless it lies apart from the cluster, and the vectors with the strongest flow to the attractor represent it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected_components

#: Landmarks of the first pass, and by how much each further pass multiplies them while the mean squared distance falls below ``GAIN`` of what it was.
FIRST, GROWTH, GAIN = 64, 4, 0.6
#: Vectors that a landmark stands for on the average, at least; pivots and vectors compared at once among those that lie apart, and how many of them must lie together to get a landmark.
SHARE, DRAWN, TOGETHER = 8, 256, 3
#: More landmarks than this (12 MB of numbers) are refused rather than left out.
MOST = 65_536


def usable(v: Column, size: int) -> Column:
    """Present, of the right length, finite and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == size) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _two_nearest(x: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest landmark and its squared distance, second nearest and its; the first twice if there is one landmark."""
    d = (landmarks**2).sum(1) - 2 * x @ landmarks.T
    rows = np.arange(len(x))
    first = d.argmin(1)
    one = ((x - landmarks[first]) ** 2).sum(1)
    if len(landmarks) == 1:
        return first, one, first, one
    d[rows, first] = np.inf
    second = d.argmin(1)
    return first, one, second, ((x - landmarks[second]) ** 2).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, _matrix(part.column("v"))


def _lowest(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    return np.array([r.v for r in vectors.select(F.xxhash64(F.lit(seed), "key").alias("h"), "v").orderBy("h").limit(n).collect()], dtype=np.float64)


def _drawn(vectors: DataFrame, landmarks, n: int, seed: int) -> tuple[float, np.ndarray]:
    """Mean squared distance of all vectors from their landmarks (a broadcast array), and ``n`` vectors drawn with chances by it: those with the least of -ln(u) / distance, ``u`` from the key's hash."""

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            u = (b.column("h").to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
            far = _two_nearest(x, landmarks.value)[1]
            at = -np.log(np.maximum(u, 1e-300)) / np.maximum(far, 1e-300)
            best = np.argsort(at)[:n]
            yield pa.record_batch([pa.array(at[best]), b.column("v").take(pa.array(best)), pa.array(np.where(np.arange(len(best)) == 0, far.sum(), 0.0)), pa.array(np.where(np.arange(len(best)) == 0, len(x), 0))], names=["at", "v", "far", "n"])

    seen = Observation()
    raced = vectors.select(F.xxhash64(F.lit(seed), "key").alias("h"), "v").mapInArrow(race, "at double, v array<double>, far double, n bigint").observe(seen, F.sum("far").alias("far"), F.sum("n").alias("n"))
    some = raced.orderBy("at").limit(n).select("v").collect()
    return seen.get["far"] / seen.get["n"], np.array([r.v for r in some])


def _means(vectors: DataFrame, landmarks: np.ndarray, least: int = 1, within: float = np.inf) -> np.ndarray:
    """The landmarks moved to the means of the vectors nearest to them (and no farther than ``within``), those of fewer than ``least`` left out. Sums are made per task, so at most tasks x landmarks rows are shuffled."""
    k, dim = landmarks.shape
    sent = vectors.sparkSession.sparkContext.broadcast(landmarks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim)), np.zeros(k)
        for _, x in _blocks(batches):
            at = ((sent.value**2).sum(1) - 2 * x @ sent.value.T).argmin(1)
            if within < np.inf:
                near = ((x - sent.value[at]) ** 2).sum(1) <= within**2
                x, at = x[near], at[near]
                if not len(x):
                    continue
            order = np.argsort(at, kind="stable")
            own, begin = np.unique(at[order], return_index=True)
            total[own] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(at, minlength=k)
        seen = np.flatnonzero(count)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))], names=["landmark", "n", "s"])

    parts = vectors.select("v").mapInArrow(sums, "landmark int, n double, s array<double>")
    added = parts.groupBy("landmark").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"))
    found = sorted(added.collect(), key=lambda r: r.landmark)  # one row a landmark
    kept = [r for r in found if r.n >= least] or found
    return np.array([np.array(r.s) / r.n for r in kept])


def _placed(vectors: DataFrame, landmarks: np.ndarray) -> DataFrame:
    """``vectors`` with ``landmark``, ``distance``, ``second`` (the next landmark) and ``between``: how far towards the middle of the two a vector lies, from 0 to 1."""
    sent = vectors.sparkSession.sparkContext.broadcast(landmarks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            first, one, second, two = _two_nearest(x, sent.value)
            gap = ((sent.value[first] - sent.value[second]) ** 2).sum(1)
            between = np.clip(1 - (two - one) / np.maximum(gap, 1e-300), 0, 1) * (first != second)
            yield pa.record_batch([b.column("key"), b.column("v"), pa.array(first.astype(np.int32)), pa.array(np.sqrt(one)), pa.array(second.astype(np.int32)), pa.array(between)], names=["key", "v", "landmark", "distance", "second", "between"])

    return vectors.mapInArrow(place, "key string, v array<double>, landmark int, distance double, second int, between double")


def _limit(placed: DataFrame) -> float:
    """How far a vector lies from its landmark at most unless it lies apart: median and eight median deviations over all vectors."""
    half = placed.agg(F.percentile_approx("distance", 0.5, 1000)).first()[0] or 0.0
    spread = placed.agg(F.percentile_approx(F.abs(F.col("distance") - half), 0.5, 1000)).first()[0] or 0.0
    return half + 8 * spread + 1e-9


def _dense(x: np.ndarray, own: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors ``own`` some with ``TOGETHER`` or more of ``x`` within ``limit``, no two of them within it but every other such one of ``own`` within it of one, and how many lie there."""
    norm, open_, kept, counts = (x**2).sum(1), own.copy(), [], []
    while len(some := np.flatnonzero(open_)[:DRAWN]):
        near = norm[some][:, None] - 2 * x[some] @ x.T + norm <= limit**2 * (1 + 1e-9)
        open_[some] = False
        n, left = near.sum(1), np.ones(len(some), bool)
        for i in np.argsort(-n, kind="stable"):
            if n[i] >= TOGETHER and left[i]:
                kept.append(some[i])
                counts.append(n[i])
                open_[near[i]] = False
                left &= ~near[i][some]
    return np.array(kept, np.int64), np.array(counts, np.int64)


def _more_landmarks(apart: DataFrame, limit: float, seed: int) -> np.ndarray:
    """Vectors that lie apart with ``TOGETHER`` or more of them within ``limit``, no two of them within it; every other such vector is within twice ``limit`` of one.

    All are compared: each vector goes to the cell of its nearest pivot and, as a neighbour, to any whose border it is within ``limit`` of, so no pair within ``limit`` is missed. The drawn
    pivots only divide the work.
    """
    pivots = _lowest(apart, DRAWN, seed)
    if not len(pivots):
        return pivots
    sent = apart.sparkSession.sparkContext.broadcast(pivots)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        between = np.sqrt(((p[:, None] - p) ** 2).sum(2))
        for b, x in _blocks(batches):
            d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
            first = d.argmin(1)
            slack = d - d[np.arange(len(x)), first][:, None]
            row, cell = np.nonzero(slack <= 2 * limit * between[first] * (1 + 1e-9) + 1e-9 * (1 + np.abs(d)))
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(first[row] == cell), b.column("key").take(pa.array(row)), b.column("v").take(pa.array(row))], names=["cell", "own", "key", "v"])

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        at, n = _dense(np.vstack(rows["v"].to_numpy()).astype(np.float64), rows["own"].to_numpy(bool), limit)
        return rows.iloc[at][["key", "v"]].assign(n=n)

    cells = apart.select("key", "v").mapInArrow(spread, "cell int, own boolean, key string, v array<double>")
    some = cells.groupBy("cell").applyInPandas(found, "key string, v array<double>, n bigint").limit(MOST + 1).toPandas().sort_values(["n", "key"], ascending=[False, True])
    if len(some) > MOST:
        raise RuntimeError(f"more than {MOST} landmarks")
    if some.empty:
        return np.zeros((0, pivots.shape[1]))
    x, kept = np.vstack(some["v"].to_numpy()).astype(np.float64), []
    left = np.ones(len(x), bool)
    for i in range(len(x)):
        if left[i]:
            kept.append(i)
            left &= ((x - x[i]) ** 2).sum(1) > limit**2
    return x[kept]


def _with_landmarks(vectors: DataFrame, seed: int) -> tuple[DataFrame, np.ndarray] | None:
    """``vectors`` placed among landmarks (written), and the landmarks; None for no vectors."""
    total = vectors.count()
    if not total:
        return None
    at = np.unique(_lowest(vectors, max(1, min(FIRST, total // SHARE)), seed), axis=0)
    spark, fewer, before = vectors.sparkSession, None, 0.0
    while True:
        more = min(max(GROWTH * len(at), FIRST), total // SHARE, MOST) - len(at)
        mean, drawn = _drawn(vectors, spark.sparkContext.broadcast(at), max(more, 1), seed + len(at))
        if fewer is not None and mean > GAIN * before:
            at = fewer if len(fewer) > FIRST else at  # the first ones were drawn without regard to distances
            break
        if more <= 0 or mean == 0:
            break
        fewer, at, before = at, np.vstack([at, drawn]), mean
    at = np.unique(_means(vectors, _means(vectors, at), SHARE // 2), axis=0)
    placed, limit = cut_lineage(_placed(vectors, at)), float("inf")
    # ends: each further landmark takes limit**2 or more from the sum of squared distances, each counted as limit**2 at most, and neither a smaller limit nor the means of those within it add to that sum
    while True:
        limit = min(limit, _limit(placed))
        more = _more_landmarks(placed.filter(F.col("distance") > limit), limit, seed + len(at))
        if not len(more):
            return placed, at
        at = np.vstack([at, more])
        if len(at) > MOST:
            raise RuntimeError(f"more than {MOST} landmarks")
        at = np.unique(_means(vectors, at, within=limit), axis=0)
        placed = cut_lineage(_placed(vectors, at), instead_of=placed)


def markov_flow(edges: DataFrame, inflation: float = 2.0, prune: float = 1e-3, max_rounds: int = 40, parts: int = 4) -> DataFrame:
    """The resting flow (``i``, ``j``, ``w``) of a weighted graph: column ``j`` tells where a walk from ``j`` ends, ``i`` is an attractor.

    ``edges``: (``i`` int, ``j`` int, ``w`` double > 0), both directions and loops given. Each round squares the column-stochastic matrix by a join and a sum, raises entries to ``inflation``,
    drops those under ``prune`` (the largest of a column always stays, so no column empties) and scales columns to 1; a column has at most as many entries as there are nodes. Sums and
    column windows share one partitioning by ``j``. Rounds are written to the shared folder; two numbers a round reach the driver.
    """
    column = Window.partitionBy("j")

    def scaled(m: DataFrame) -> DataFrame:
        return m.withColumn("w", F.col("w") / F.sum("w").over(column))

    now, last = cut_lineage(scaled(edges.repartition(parts, "j"))), None
    for _ in range(max_rounds):
        left, right = now.select("i", F.col("j").alias("k"), F.col("w").alias("x")).repartition(parts, "k"), now.select(F.col("i").alias("k"), "j", F.col("w").alias("y")).repartition(parts, "k")
        squared = left.join(right, "k").select("i", "j", (F.col("x") * F.col("y")).alias("w")).repartition(parts, "j").groupBy("i", "j").agg(F.sum("w").alias("w"))
        blown = scaled(squared.select("i", "j", F.pow("w", F.lit(inflation)).alias("w"))).withColumn("top", F.max("w").over(column))
        now = cut_lineage(scaled(blown.filter((F.col("w") >= prune) | (F.col("w") == F.col("top"))).select("i", "j", "w")), instead_of=now)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("energy")).first()
        if last is not None and state.n == last.n and abs((state.energy or 0) - (last.energy or 0)) < 1e-5 * max(1, last.n):
            return now
        last = state
    raise RuntimeError(f"the flow doesn't rest after {max_rounds} rounds")


def _similarities(placed: DataFrame, landmarks: np.ndarray, least: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Edges (``i``, ``j``, ``w``), both directions and loops, and (``landmark``, ``spread``).

    ``w`` is the greater of a Gaussian of two landmarks' distance, as wide as 0.7 of the lesser median distance of the vectors from them (so that scattered vectors link nothing), and of the share of the smaller one's vectors that lie in the
    middle quarter between the two, beside the share in the halves of one round cluster. Landmarks (no vectors) are compared with each other in blocks on the executors.
    """
    spark = placed.sparkSession
    own = placed.groupBy("landmark").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", 0.5, 200).alias("spread"))
    found = own.collect()  # one row a landmark
    size, spread = np.zeros(len(landmarks)), np.zeros(len(landmarks))
    for r in found:
        size[r.landmark], spread[r.landmark] = r.n, r.spread
    sent = spark.sparkContext.broadcast((landmarks, spread))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wide = sent.value
        for b in batches:
            for rows in np.array_split(b.column("id").to_numpy(), max(1, b.num_rows * len(at) // (1 << 22))):
                gap = (at[rows] ** 2).sum(1)[:, None] - 2 * at[rows] @ at.T + (at**2).sum(1)
                w = np.exp(-np.maximum(gap, 0) / (2 * (0.7 * np.maximum(np.minimum(wide[rows][:, None], wide), 1e-9)) ** 2))
                w[np.arange(len(rows)), rows] = 1.0
                i, j = np.nonzero(w >= least)
                yield pa.record_batch([pa.array(rows[i].astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(w[i, j])], names=["i", "j", "w"])

    gaussian = spark.range(0, len(landmarks), 1, max(1, len(landmarks) // 256)).mapInArrow(near, "i int, j int, w double")
    sizes = spark.createDataFrame([(k, float(n)) for k, n in enumerate(size) if n], "i int, n double")
    pairs = placed.filter("between > 0.75 and landmark <> second").groupBy(F.least("landmark", "second").alias("i"), F.greatest("landmark", "second").alias("j")).agg(F.count(F.lit(1)).alias("m"))
    share = F.least(F.lit(1.0), F.col("m") / F.least("n", "n2") / 0.32)
    middle = pairs.join(F.broadcast(sizes), "i").join(F.broadcast(sizes.select(F.col("i").alias("j"), F.col("n").alias("n2"))), "j").select("i", "j", share.alias("w")).filter(F.col("w") >= least)
    both = gaussian.unionByName(middle).unionByName(middle.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("w")), spark.createDataFrame([(r.landmark, float(r.spread)) for r in found], "landmark int, spread double")


def _attractors(flow: DataFrame, edges: DataFrame) -> DataFrame:
    """(``landmark``, ``cluster``, ``pull``): each landmark with its strongest attractor's cluster, and how much of its walks goes to the attractor at once. Attractors that share a walk's end are one cluster, named by the least of them."""
    ends = flow.filter("w > 0.05")
    best = flow.groupBy("j").agg(F.max_by("i", F.struct("w", -F.col("i"))).alias("i"))
    tied = ends.join(best.select("j", F.col("i").alias("first")), "j").select(F.col("first").cast("long").alias("u"), F.col("i").cast("long").alias("v"))
    names = connected_components(tied)
    total = edges.groupBy("j").agg(F.sum("w").alias("all"))
    step = edges.join(total, "j").select("i", "j", (F.col("w") / F.col("all")).alias("pull"))
    return best.join(names, F.col("i") == F.col("node")).join(step, ["i", "j"], "left").select(F.col("j").alias("landmark"), F.col("component").cast("int").alias("cluster"), F.coalesce("pull", F.lit(0.0)).alias("pull"))


def _gap(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(F.col(a).cast("array<double>"), b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cluster_vectors(rows: DataFrame, key: str = "example_id", vector: str = "v", size: int = 24, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Members (``key``, ``v``, ``landmark``, ``cluster``, ``flow``, ``from_middle``, ``inside``) and clusters (``cluster``, ``middle``, ``reach``, ``size``).

    Every row with a usable vector is a member of exactly one cluster; repeated rows of a key count once, by their least vector; unusable vectors and null keys are left out; empty input gives
    empty results. ``inside`` is false for strays: members farther from their cluster's middle than its median distance plus eight times half its quartiles' gap (``reach``). ``flow`` is the landmark's flow to
    the attractor, less the farther the vector lies from the landmark. Broadcast and collected: landmarks (at most ``MOST``, refused beyond), never vectors but the drawn ones.
    """
    vectors = cut_lineage(rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("key").isNotNull() & usable(F.col("v"), size)).groupBy("key").agg(F.min("v").alias("v")))
    found = _with_landmarks(vectors, seed)
    if found is None:
        empty = vectors.select("key", "v", F.lit(0).alias("landmark"), F.lit(0).alias("cluster"), F.lit(0.0).alias("flow"), F.lit(0.0).alias("from_middle"), F.lit(True).alias("inside"))
        return empty, empty.select("cluster", F.col("v").alias("middle"), F.col("flow").alias("reach"), F.lit(0).cast("long").alias("size"))
    placed, at = found
    edges, spreads = _similarities(placed, at)
    edges = cut_lineage(edges)
    named = _attractors(markov_flow(edges), edges).join(spreads, "landmark")
    flow = F.col("pull") * F.exp(-F.pow(F.col("distance") / F.greatest("spread", F.lit(1e-9)), F.lit(2.0)) / 2)
    members = placed.join(F.broadcast(cut_lineage(named)), "landmark").select("key", "v", "landmark", "cluster", flow.alias("flow"))
    middles = cut_lineage(members.groupBy("cluster").agg(F.array(*[F.percentile_approx(F.col("v")[i], 0.5, 1000) for i in range(size)]).alias("middle"), F.count(F.lit(1)).alias("size")))
    far = members.join(F.broadcast(middles), "cluster").withColumn("from_middle", _gap("v", "middle")).drop("middle", "size")
    half = far.groupBy("cluster").agg(F.percentile_approx("from_middle", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.col("q")[2] - F.col("q")[1])
    clusters = cut_lineage(middles.join(half, "cluster").select("cluster", "middle", "size", (F.col("q")[1] + 8 * spread + 1e-9).alias("reach")))
    return far.join(F.broadcast(clusters.select("cluster", "reach")), "cluster").withColumn("inside", F.col("from_middle") <= F.col("reach")).drop("reach"), clusters


def name_clusters(members: DataFrame, clusters: DataFrame, centroids: DataFrame) -> DataFrame:
    """Members inside a cluster that holds a given centroid: (``example_id``, ``cluster_id``).

    ``centroids`` (``cluster_id``, ``centroid``) is a small table of one row per cluster. A cluster holds a centroid that lies within its reach, and no farther from its middle than
    the reach of the cluster nearest to the centroid (so a wide one of strays holds none); of several, the nearest to its middle names it. Unusable centroids name nothing.
    """
    held = clusters.crossJoin(F.broadcast(centroids.select("cluster_id", "centroid"))).filter(F.size("centroid") == F.size("middle")).withColumn("gap", _gap("centroid", "middle"))
    near = F.min_by("reach", F.struct("gap", "cluster")).over(Window.partitionBy("cluster_id"))
    held = held.withColumn("near", near).filter((F.col("gap") <= F.col("reach")) & (F.col("gap") <= F.col("near")))
    names = held.groupBy("cluster").agg(F.min_by("cluster_id", F.struct("gap", "cluster_id")).alias("cluster_id"))
    return members.filter("inside").join(F.broadcast(names), "cluster").select(F.col("key").alias("example_id"), F.col("cluster_id").cast("int").alias("cluster_id"))


def describe_clusters(members: DataFrame, clusters: DataFrame, typical: int = 5) -> DataFrame:
    """(``cluster``, ``size``, ``inside``, ``reach``, ``typical``): its size and the ``typical`` members with the strongest flow to its attractor, strongest first.

    The strongest are kept per group of hashed keys before the cluster's own list is made, so no task holds a cluster.
    """
    window = Window.partitionBy("cluster", "_s").orderBy(F.desc("flow"), "key")
    salted = members.filter("inside").select("cluster", "key", "flow", F.pmod(F.xxhash64("key"), F.lit(64)).alias("_s"))
    counts = salted.groupBy("cluster").agg(F.count(F.lit(1)).alias("inside"))
    some = salted.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= typical)
    best = some.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("less"), "key"))), 1, typical).alias("near"))
    return clusters.join(counts, "cluster", "left").join(best, "cluster", "left").select("cluster", "size", F.coalesce("inside", F.lit(0)).alias("inside"), "reach", F.coalesce(F.transform("near", lambda s: s.key), F.array().cast("array<string>")).alias("typical"))
