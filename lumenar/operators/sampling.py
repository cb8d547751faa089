"""Examples for the experts of a mixture, and the bookkeeping of their training (survey F2, L10, L11, W8, W9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_expert(examples: DataFrame, expert: int | None) -> tuple[DataFrame, DataFrame]:
    """Examples inside and outside the expert's cluster (F2); rows without cluster lie outside. None (a single expert for all): all, and none."""
    if expert is None:
        return examples, examples.limit(0)
    same = F.col("cluster_id").eqNullSafe(F.lit(expert))
    return examples.filter(same), examples.filter(~same)


def draw_complement(outside: DataFrame, n: int, seed: int, by_cluster: bool = False, rows_per_bucket: int = 100_000) -> DataFrame:
    """``n`` draws with replacement from the examples outside (L10), or from a cluster chosen evenly first (L11): each row with ``copies``, how often it is drawn.

    Rows are numbered by their hash within buckets, buckets one after another; the draws are ``n`` even steps with one random offset along the rows' summed weights, so no row is collected, the
    copies of a row are its expectation rounded up or down, and they add up to ``n``. Empty input gives no rows.
    """
    total = outside.count()
    if not total:
        return outside.withColumn("copies", F.lit(0))
    own = outside.groupBy("cluster_id").agg((1.0 / F.count(F.lit(1))).alias("_each"))  # one row a cluster
    clusters = own.count() if by_cluster else total
    weighed = outside.join(F.broadcast(own), outside["cluster_id"].eqNullSafe(own["cluster_id"])).drop(own["cluster_id"]) if by_cluster else outside.withColumn("_each", F.lit(1.0))
    buckets = max(1, math.ceil(total / rows_per_bucket))
    h = F.xxhash64(F.lit(seed), "example_id")
    rows = weighed.withColumn("_w", F.col("_each") * n / clusters).withColumn("_b", F.pmod(h, F.lit(buckets)))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    upto = F.sum("_w").over(Window.partitionBy("_b").orderBy(h, "example_id").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    offset = F.pmod(F.xxhash64(F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    placed = rows.join(F.broadcast(before), "_b").withColumn("_u", upto)
    step = lambda u: F.floor(F.round(u, 7) + offset)
    copies = step(F.col("_u")) - step(F.col("_u") - F.col("_w"))
    return placed.withColumn("copies", copies.cast("int")).filter("copies > 0").select(*outside.columns, "copies")


def early_stopping(epochs: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", loss: str = "validation_loss") -> DataFrame:
    """Logged epochs with ``best`` (least loss so far), ``improved`` and ``stopped`` (as many as ``patience`` epochs, or more, without improvement before)."""
    own = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("best", F.min(loss).over(own)).withColumn("improved", before.isNull() | (F.col(loss) < before))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("stopped", F.coalesce(F.col(epoch) - last > patience, F.lit(False)))


def accumulation_groups(batches: DataFrame, steps: int, order: str = "batch") -> DataFrame:
    """Batches (numbered from 0) with the ``group`` whose gradients they share and its ``group_size``; the last may be smaller."""
    return batches.withColumn("group", F.floor(F.col(order) / steps).cast("int")).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("group")).cast("int"))
