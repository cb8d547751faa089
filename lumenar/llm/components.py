"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _towards_minimum(directed: DataFrame) -> DataFrame:
    """Each row (u, v) with the least of u and all its v. Minima are combined before the shuffle; a hot u is split by AQE's skew join, never gathered."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _towards_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _towards_minimum(down)
    return near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Component of every node that has an edge: (``node``, ``component``), the component being its smallest node.

    ``edges``: (``u`` bigint, ``v`` bigint), undirected; loops, repeats and nulls are allowed (rows with a null are ignored). No edges give an empty result. Each round is written to the
    shared folder, so that a lost executor costs one round. Only two numbers a round reach the driver.
    """
    loops = edges.dropna().filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now, last = cut_lineage(edges.dropna().filter("u <> v").select("u", "v").distinct()), None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)).filter("u <> v").distinct(), instead_of=now)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return found.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
