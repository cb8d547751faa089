"""Mixing sources to target weights (problem 8): systematic sampling along a prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


def source_name(source: Column) -> Column:
    """Lower case, parts joined by single underscores: the form of the targets."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def _plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``available``, ``rate``): expected copies of each text of a source.

    The total is the largest for which every source that has texts can give its share within its repeats; shares are scaled to the sources that have any.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    both = wanted.join(have, "source").filter("available > 0")
    whole = both.agg(F.sum("target_share").alias("shares"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("most"))
    return both.crossJoin(F.broadcast(whole)).select("source", (F.col("target_share") / F.col("shares")).alias("target_share"), "max_repeats", "available", F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("most") / F.col("available")).alias("rate"))


def mixed_texts(sized: DataFrame, targets: DataFrame, seed: int = 29, rows_per_bucket: int = 100_000) -> DataFrame:
    """(``doc_id``, ``source``, ``tokens``, ``copies``) of the texts that are taken, each with how often.

    Along each source, ordered by size class, every text adds its expected copies to a prefix sum that starts at one random offset; a text is taken once for each whole number it crosses,
    so its copies are its expectation rounded up or down and never above ``max_repeats``. The order by size makes the tokens taken follow their expectation closely.
    The prefix sum is split: a source's size classes are cut into hashed buckets of about ``rows_per_bucket`` texts, buckets are counted, and only inside a bucket are texts numbered, so a
    source that holds a third of all rows is no single task. ``targets`` is a small table, broadcast.
    Texts of sources without target, of null source, and without tokens are left out; empty tables give no rows.
    """
    named = cut_lineage(sized.filter("tokens > 0").withColumn("source", source_name(F.col("source"))).filter("source is not null"))
    plan = _plan(named, targets)
    size_class = F.floor(F.log2(F.col("tokens").cast("double")) * 4).cast("int")
    classed = named.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("class", size_class)
    wide = classed.groupBy("source", "class").agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).cast("int").alias("buckets"))
    spread = classed.join(F.broadcast(wide), ["source", "class"]).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("buckets")).cast("int"))
    counts = spread.groupBy("source", "class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("class", "bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id"))
    numbered = spread.withColumn("place", place).join(before, ["source", "class", "bucket"])
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda n: F.floor(n * F.col("rate") + offset)
    at = F.col("before") + F.col("place")
    return numbered.select("doc_id", "source", "tokens", (upto(at) - upto(at - 1)).cast("int").alias("copies")).filter("copies > 0")


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(``source``, ``target_share``, ``actual_share``, ``tokens``, ``texts``, ``copies``, ``most_copies``) of each source with a target and texts."""
    plan = _plan(sized.filter("tokens > 0").withColumn("source", source_name(F.col("source"))), targets).select("source", "target_share")
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("all"))
    return plan.join(per, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
