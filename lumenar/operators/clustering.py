"""Fitting clusters: k-means with the number of clusters chosen by the Euclidean silhouette (survey C7-C11, L5, L9, L12, J11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the sample that silhouettes are taken on, at most.
SILHOUETTE_ROWS = 10_000
#: Rounds of k-means at most, how far a center moves at most in the last one, and vectors that are compared at once.
ROUNDS, TOLERANCE, BLOCK = 300, 1e-4, 2048


def candidate_counts(rows: int, least: int = 2, most: int = 10, fixed: int | None = None) -> list[int]:
    """Numbers of clusters to try."""
    if rows < 1:
        raise ValueError("no rows to cluster")
    if fixed is not None:
        if not 1 <= fixed <= rows:
            raise ValueError(f"{fixed} clusters of {rows} rows")
        return [fixed]
    if rows < 3:
        return [1]
    return list(range(least, min(most, rows - 1) + 1))


def silhouette_sample(assigned: DataFrame, key: str = "example_id", rows: int = SILHOUETTE_ROWS, seed: int = 2026) -> DataFrame:
    """At most ``rows`` rows, those whose salted hashes are least."""
    return assigned.orderBy(F.xxhash64(F.lit(seed), key), key).limit(rows)


def _silhouette_block(d: np.ndarray, k: np.ndarray, one_hot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes of rows of the clusters ``k``; ``d``: their distances from the whole sample, ``one_hot``: its clusters, ``sizes``: of those."""
    if len(sizes) < 2:
        return np.zeros(len(d))
    sums, i = d @ one_hot, np.arange(len(d))
    inside = sums[i, k] / np.maximum(sizes[k] - 1, 1)
    other = sums / sizes
    other[i, k] = np.inf
    return np.where(sizes[k] > 1, (other.min(1) - inside) / np.maximum(np.maximum(inside, other.min(1)), 1e-300), 0.0)


def silhouettes(sample: DataFrame, key: str = "example_id", vector: str = "v", cluster: str = "cluster") -> DataFrame:
    """(``key``, ``silhouette``) of each row of a sample of at most ``SILHOUETTE_ROWS`` (C9); 0 for the only member of a cluster.

    The sample is broadcast, bounded as it is, and each batch is compared with it as a block: distances are never rows.
    """
    held = sample.select(vector, cluster).limit(SILHOUETTE_ROWS).toPandas()
    if held.empty:
        return sample.select(F.col(key), F.lit(0.0).alias("silhouette"))
    points, labels = np.vstack(held[vector].to_numpy()).astype(np.float64), held[cluster].to_numpy()
    names, own = np.unique(labels, return_inverse=True)
    sizes, one_hot = np.bincount(own), np.eye(len(names))[own]
    squares = (points**2).sum(1)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for at in range(0, len(rows), 500):
                part = rows.iloc[at : at + 500]
                x = np.vstack(part[vector].to_numpy()).astype(np.float64)
                k = np.searchsorted(names, part[cluster].to_numpy())
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + squares - 2 * x @ points.T, 0))
                out.append(_silhouette_block(d, k, one_hot, sizes))
            yield pd.DataFrame({key: rows[key], "silhouette": np.concatenate(out) if out else np.zeros(0)})

    return sample.select(key, vector, cluster).mapInPandas(block, f"{key} string, silhouette double")


def _packed(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """Rows (``keys``, ``h``, ``x``) of many keys, their hashes and their vectors as bytes, so that a pass costs little besides the distances, and the vectors' number type (their own)."""
    kind = "f4" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, h = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind), b.column("h").to_numpy()
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("key")), pa.array([h.tobytes()]), pa.array([x.tobytes()])], names=["keys", "h", "x"])

    of = T.StructType([T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("h", T.BinaryType()), T.StructField("x", T.BinaryType())])
    numbers = F.col(vector) if kind == "f4" else F.col(vector).cast("array<double>")
    return rows.select(F.col(key).alias("key"), numbers.alias("v"), F.xxhash64(key).alias("h")).mapInArrow(pack, of), kind


def _unpacked(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray]]:
    for b in batches:
        for r in range(b.num_rows):
            h = np.frombuffer(b.column("h")[r].as_buffer(), np.uint64)
            yield b.column("keys")[r].values if "keys" in b.schema.names else None, h, np.frombuffer(b.column("x")[r].as_buffer(), kind).reshape(len(h), -1).astype(np.float64)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers above 0 and up to 1 by hash and salt."""
    for k in (salt + 1, 2):
        h = (h ^ (h >> np.uint64(31)) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def _seedings(packed: DataFrame, kind: str, most: int, starts: int, seed: int) -> list[np.ndarray]:
    """``starts`` lists of ``most`` centers by k-means++ over all rows (fewer if there are fewer distinct vectors): each is drawn with chances by the squared distance from those before, in one pass for all lists."""
    lists: list[list] = [[] for _ in range(starts)]
    for _ in range(most):
        sent = [np.array(x) for x in lists]

        def race(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for _, h, x in _unpacked(batches, kind):
                for s, c in enumerate(sent):
                    far = np.min([((x - one) ** 2).sum(1) for one in c], axis=0) if len(c) else np.ones(len(x))
                    at = np.where(far > 0, -np.log(_uniform(h, seed + s + 1000003 * len(c))) / np.maximum(far, 1e-300), np.inf)
                    i = int(at.argmin())
                    if at[i] < best.get(s, (np.inf, None))[0]:
                        best[s] = (at[i], x[i])
            yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array([float(a) for a, _ in best.values()], pa.float64()), pa.array([v for _, v in best.values()], pa.list_(pa.float64()))], names=["s", "at", "v"])

        drawn = packed.select("h", "x").mapInArrow(race, "s int, at double, v array<double>").groupBy("s").agg(F.min(F.struct("at", "v")).alias("m")).collect()
        if not drawn:
            break
        for r in drawn:
            lists[r.s].append(r.m.v)
    return [np.array(x) for x in lists]


def _step(packed: DataFrame, kind: str, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """One round of k-means for all ``models`` (centers) in one pass over all rows: the centers moved to the means of the vectors nearest to them (one without any stays), and the costs of the given ones."""
    begin = np.cumsum([0] + [len(m) for m in models])
    sent = packed.sparkSession.sparkContext.broadcast(np.vstack(models))
    by_size = {k: np.array([i for i, m in enumerate(models) if len(m) == k]) for k in sorted({len(m) for m in models})}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        norm, total, count, cost = (c**2).sum(1)[:, None], np.zeros(c.shape), np.zeros(len(c)), np.zeros(len(c))
        for _, _, every in _unpacked(batches, kind):
            for at in range(0, len(every), BLOCK):
                x = every[at : at + BLOCK]
                d, squares = norm - 2 * (c @ x.T), (x**2).sum(1)
                own = np.empty(d.shape)
                for k, which in by_size.items():
                    rows = begin[which][:, None] + np.arange(k)
                    part = d[rows]
                    least = part.min(1)
                    nearest = part == least[:, None]
                    if (tied := nearest.sum(1) > 1).any():
                        nearest &= (np.cumsum(nearest, axis=1) == 1) | ~tied[:, None]
                    own[rows] = nearest
                    cost[begin[which]] += np.maximum(least + squares, 0).sum(1)
                total += own @ x
                count += own.sum(1)
        yield pa.record_batch([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(count), pa.array(cost), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "n", "cost", "s"])

    dim = models[0].shape[1]
    added = packed.select("h", "x").mapInArrow(sums, "i int, n double, cost double, s array<double>").groupBy("i").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("s")[j]) for j in range(dim)]).alias("s"))
    moved, cost = np.vstack(models), np.zeros(begin[-1])
    for r in added.collect():  # one row a center
        cost[r.i] = r.cost
        if r.n:
            moved[r.i] = np.array(r.s) / r.n
    return [moved[a:b] for a, b in zip(begin, begin[1:])], [float(cost[a]) for a in begin[:-1]]


def _best_fits(packed: DataFrame, kind: str, counts: list[int], starts: int, seed: int) -> dict[int, np.ndarray]:
    """For each number of clusters the centers of the least cost of ``starts`` seedings. All models that still move share each pass, so there are as many passes as the slowest takes rounds."""
    lists = _seedings(packed, kind, max(counts), starts, seed)
    names = [(k, s) for k in counts for s in range(starts if k > 1 else 1)]
    moving, ended = {n: lists[n[1]][: n[0]] for n in names}, {}
    for turn in range(ROUNDS + 1):
        moved, costs = _step(packed, kind, list(moving.values()))
        for (name, before), after, cost in zip(list(moving.items()), moved, costs):
            if turn == ROUNDS or ((after - before) ** 2).sum(1).max() <= TOLERANCE**2:
                ended[name] = (cost, name[1], moving.pop(name))
            else:
                moving[name] = after
        if not moving:
            break
    return {k: min((e for (n, _), e in ended.items() if n == k), key=lambda e: e[:2])[2] for k in counts}


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def _scores(spark, points: np.ndarray, fits: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette of the sample by number of clusters; its distances are computed once for all, in blocks on the executors."""
    labels = {k: np.unique(_nearest(points, c), return_inverse=True)[1] for k, c in fits.items()}
    sent = spark.sparkContext.broadcast((points, labels))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, given = sent.value
        squares = (x**2).sum(1)
        held = {k: (np.bincount(at), np.eye(at.max() + 1)[at]) for k, at in given.items()}
        for b in batches:
            ids = b.column("id").to_numpy()
            for rows in np.array_split(ids, max(1, len(ids) // 500)):
                if not len(rows):
                    continue
                d = np.sqrt(np.maximum(squares[rows][:, None] + squares - 2 * x[rows] @ x.T, 0))
                sums = [float(_silhouette_block(d, at[rows], held[k][1], held[k][0]).sum()) for k, at in given.items()]
                yield pa.record_batch([pa.array(list(given), pa.int32()), pa.array(sums)], names=["k", "s"])

    some = spark.range(0, len(points), 1, max(1, len(points) // 1000)).mapInArrow(block, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return {r.k: r.s / len(points) for r in some}


def fit_clusters(rows: DataFrame, key: str = "example_id", vector: str = "v", fixed: int | None = None, most: int = 10, starts: int = 10, seed: int = 2026) -> tuple[DataFrame, dict[int, list[float]], dict[int, float]]:
    """Assignments (``key``, ``v``, ``cluster``), centroids by cluster, silhouettes by number of clusters.

    ``rows`` need finite vectors of one length. For each number the best of ``starts`` seedings by cost is kept; of equal silhouettes the lower number wins. All numbers and seedings are fitted
    to all rows in the same passes; only centers, costs and one bounded sample reach the driver.
    """
    packed, kind = _packed(rows, key, vector)
    packed = packed.persist()
    counts = candidate_counts(packed.agg(F.sum(F.size("keys"))).first()[0] or 0, most=most, fixed=fixed)
    fits = _best_fits(packed, kind, counts, starts, seed)

    def assigned(centers: np.ndarray) -> DataFrame:
        sent = packed.sparkSession.sparkContext.broadcast(centers)

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, _, x in _unpacked(batches, kind):
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.record_batch([keys, pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(_nearest(x, sent.value).astype(np.int32))], names=[key, "v", "cluster"])

        return packed.mapInArrow(name, T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType())]))

    scores = {k: 0.0 for k in counts}
    if max(counts) > 1:
        sample = silhouette_sample(assigned(fits[counts[0]]), key).select("v").collect()
        scores |= {k: s for k, s in _scores(packed.sparkSession, np.array([r.v for r in sample]), {k: c for k, c in fits.items() if k > 1}).items()}
    best = max(counts, key=lambda k: (scores[k], -k))
    return assigned(fits[best]), {i: [float(x) for x in c] for i, c in enumerate(fits[best])}, scores


def balanced_partition(rows: DataFrame, clusters: int, key: str = "example_id", seed: int = 2026) -> DataFrame:
    """``rows`` with ``cluster``: as evenly as can be, at random but repeatable (C10). Rows are numbered within 256 hash buckets behind the buckets before, never in one task."""
    from pyspark.sql import Window

    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_b", F.pmod("_h", F.lit(256)))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_before")
    return hashed.join(F.broadcast(before), "_b").withColumn("cluster", F.pmod(place, F.lit(clusters)).cast("int")).drop("_h", "_b", "_before")
