"""Routing by distances to centroids, and what assignments tell (survey C1-C6, C12-C15, J1-J5, J9, A10-A12, L3, L4).

Centroids are a fixed few (10 by default); they are collected once and travel with the function, so routing is a projection over Arrow batches: no join, no shuffle, and it also works on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance

#: Centroids that are accepted as literals.
MOST_CENTROIDS = 4096


def centroid_rows(centroids: DataFrame) -> list[tuple[int, list[float]]]:
    """The centroids in order of their ids; none or more than ``MOST_CENTROIDS`` raise."""
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(MOST_CENTROIDS + 1).collect()
    if not 0 < len(rows) <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids are needed")
    return [(int(r.cluster_id), [float(x) for x in r.centroid]) for r in rows]


def centroid_literal(centroids: DataFrame) -> Column:
    """The centroids as an array of structs (id, centroid)."""
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("centroid")) for i, c in centroid_rows(centroids)])


def _router(centroids: list[tuple[int, list[float]]]):
    """All that is known of a vector's route in one pass over a batch. Nested array functions would evaluate the distances once for each use of them."""
    ids, at = np.array([i for i, _ in centroids]), np.array([c for _, c in centroids], dtype=np.float64)
    many, names = len(ids) > 1, ("expert", "distance", "second_distance", "margin", "router_entropy", "router_max_probability")

    @F.pandas_udf("struct<expert:int,distance:double,second_distance:double,margin:double,router_entropy:double,router_max_probability:double>")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            fits = np.flatnonzero([x is not None and len(x) == at.shape[1] for x in v])
            found: dict[str, np.ndarray] = {}
            if len(fits):
                x = np.vstack(v.iloc[fits].to_numpy()).astype(np.float64)
                d = np.sqrt(sum((x[:, k, None] - at[:, k]) ** 2 for k in range(at.shape[1])))
                order = np.argsort(d, axis=1, kind="stable")
                first = d[np.arange(len(x)), order[:, 0]]
                second = d[np.arange(len(x)), order[:, 1]] if many else np.zeros(len(x))
                z = -d / np.maximum(d.mean(1, keepdims=True), 1e-8)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                q = np.maximum(p, 1e-12)
                h = -(q * np.log(q)).sum(1) / np.log(len(ids)) if many else np.zeros(len(x))
                found = {"expert": ids[order[:, 0]], "distance": first, "second_distance": second, "margin": second - first if many else np.zeros(len(x)), "router_entropy": h, "router_max_probability": p.max(1)}
            out = pd.DataFrame({c: pd.Series(found.get(c, []), index=fits) for c in names}).reindex(range(len(v)))
            yield out.astype(object).where(out.notna(), None)

    return route


def routed(rows: DataFrame, centroids: DataFrame, vector: str = "v") -> DataFrame:
    """``rows`` with ``expert``, ``distance``, ``second_distance``, ``margin``, ``router_entropy``, ``router_max_probability``.

    Equal distances go to the lower id. With one centroid second distance, margin and entropy are 0 and the probability 1. For a vector that is null or of another length they are null;
    numbers that aren't finite give no useful route: filter by ``finite_vector`` first.
    """
    return rows.withColumn("_r", _router(centroid_rows(centroids))(F.col(vector))).select(*rows.columns, "_r.*")


def unrouted(rows: DataFrame) -> DataFrame:
    """The constants of a system without routing."""
    zeros = [F.lit(0.0).alias(c) for c in ("distance", "second_distance", "margin", "router_entropy")]
    return rows.select("*", F.lit(0).alias("expert"), *zeros, F.lit(1.0).alias("router_max_probability"))


def wrong_route(expert: Column, experts: int) -> Column:
    """The next expert instead."""
    if experts < 2:
        raise ValueError("a wrong route needs two experts")
    return F.pmod(expert + 1, F.lit(experts))


def distance_statistics(assigned: DataFrame, experts: int, cluster: str = "expert", gap: str = "distance") -> DataFrame:
    """(``expert``, ``mean``, ``std``): population statistics of each of ``experts`` clusters (A11); (0, 1) for an empty one, and a deviation under 1e-8 is 1."""
    grid = assigned.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert"))
    stats = assigned.groupBy(F.col(cluster).alias("expert")).agg(F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("std"))
    deviation = F.when(F.coalesce("std", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("std"))
    return grid.join(stats, "expert", "left").select("expert", F.coalesce("mean", F.lit(0.0)).alias("mean"), deviation.alias("std"))


def distance_z(routed_rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """With ``distance_z`` by the cluster of the natural expert (C13, J9); ``statistics`` has a row per expert."""
    return routed_rows.join(F.broadcast(statistics), "expert", "left").withColumn("distance_z", (F.col("distance") - F.col("mean")) / F.col("std")).drop("mean", "std")


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """The last fitted cluster of each example; rows of a null id are left out."""
    return assignments.filter("example_id is not null").groupBy("example_id").agg(F.max_by("cluster_id", F.struct("fitted_at", "cluster_id")).alias("fitted_cluster"))


def with_assignments(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """(``example_id``, ``cluster``, ``fitted``, ``distance``): the fitted cluster where there is one with a centroid, else the nearest (J1, J2, C14), with the distance to that centroid.

    Rows need finite vectors; one join on the id, no second scan for those not fitted.
    """
    at = centroid_literal(centroids)
    both = routed(vectors, centroids).join(latest_assignments(assignments), "example_id", "left")
    own = F.get(F.filter(at, lambda c: c["id"] == F.col("fitted_cluster")), F.lit(0))
    known = own.isNotNull()
    return both.select("example_id", F.when(known, F.col("fitted_cluster")).otherwise(F.col("expert")).alias("cluster"), known.alias("fitted"), F.when(known, distance(F.col("v"), own["centroid"])).otherwise(F.col("distance")).alias("distance"))


def inconsistent_assignments(examples: DataFrame, assignments: DataFrame) -> DataFrame:
    """(``example_id``, ``cluster_id``, ``fitted_cluster``) where the recorded cluster isn't the fitted one (J4), null counting as a difference."""
    return examples.select("example_id", "cluster_id").join(latest_assignments(assignments), "example_id").filter(~F.col("cluster_id").eqNullSafe(F.col("fitted_cluster")))


def id_differences(left: DataFrame, right: DataFrame, key: str = "example_id") -> DataFrame:
    """(``only_left``, ``only_right``): numbers of distinct ids on one side only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"))


def cluster_counts(rows: DataFrame, clusters: int, split: str = "split", cluster: str = "expert") -> DataFrame:
    """(``split``, ``cluster``, ``examples``) for every split and each of ``clusters`` clusters, 0 where there is none (A10). The grid is made of the counts, not of the rows."""
    counts = rows.groupBy(F.col(split).alias("split"), F.col(cluster).cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("split").distinct().select("split", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))).alias("cluster"))
    return grid.join(counts, (grid.split.eqNullSafe(counts.split)) & (grid.cluster == counts.cluster), "left").select(grid.split, grid.cluster, F.coalesce("n", F.lit(0)).alias("examples"))


def means_of(rows: DataFrame, size: int, cluster: str = "expert", vector: str = "v") -> DataFrame:
    """(``cluster_id``, ``centroid``): the mean vector of each cluster (A12), one aggregate per place, combined before the shuffle."""
    return rows.groupBy(F.col(cluster).alias("cluster_id")).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(size)]).alias("centroid"))


