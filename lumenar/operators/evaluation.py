"""Measures of confidence against outcome (survey A1-A9, A13-A25, W1-W5, F1, F3, F4, K20-K25, U2).

Facts are rows (``confidence``, ``outcome``) with an order (``_pos``) that breaks ties. Ranks over all rows never sort into one task: rows are first counted by distinct confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clipped


def checked(facts: DataFrame) -> DataFrame:
    """``facts`` if confidences lie in [0, 1] and outcomes are 0 or 1, else an error at run time (F1)."""
    p, y = F.col("confidence").cast("double"), F.col("outcome").cast("double")
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1) | y.isNull() | ~y.isin(0.0, 1.0)
    return facts.withColumn("confidence", F.when(bad, F.raise_error(F.lit("confidence must lie in [0, 1] and outcome be 0 or 1")).cast("double")).otherwise(p)).withColumn("outcome", y)


def _ranked(facts: DataFrame, by: str = "confidence") -> DataFrame:
    """(``value``, ``n``, ``hits``, ``below``): counts by distinct value and the number of rows below; distinct values, rounded by nothing, are fewer than rows where the scale is coarse."""
    counts = facts.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("hits"))
    return running(counts, "value", {"below": "n"})


def running(counts: DataFrame, order: str, sums: dict[str, str], descending: bool = False, buckets: int = 200) -> DataFrame:
    """``counts`` (distinct values of ``order``) with, for each name in ``sums``, the sum over rows strictly before.

    Two levels: approximate quantiles cut the values into ``buckets``, whose totals are summed first; only inside a bucket is a window sorted.
    """
    cuts = sorted(set(counts.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001))) if order else []
    bucket = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + F.when(F.col(order) >= c, 1).otherwise(0)) if cuts else F.lit(0)
    placed = counts.withColumn("_b", -bucket if descending else bucket)
    totals = placed.groupBy("_b").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    ahead = totals.select("_b", *[F.coalesce(F.sum(f"_{name}").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(ahead), "_b")
    for name, c in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{name}")).drop(f"_{name}")
    return out.drop("_b")


def scalar_metrics(facts: DataFrame) -> DataFrame:
    """One row: ``examples``, ``accuracy``, ``mean_confidence``, ``brier``, ``log_loss``."""
    p, y = F.col("confidence"), F.col("outcome")
    loss = -(y * F.ln(clipped(p, 1e-12, 1 - 1e-12)) + (1 - y) * F.ln(clipped(1 - p, 1e-12, 1 - 1e-12)))
    return facts.agg(F.count(F.lit(1)).alias("examples"), F.avg(y).alias("accuracy"), F.avg(p).alias("mean_confidence"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def reliability_bins(facts: DataFrame, bins: int = 15, adaptive: bool = False) -> DataFrame:
    """(``bin``, ``count``, ``mean_confidence``, ``accuracy``, ``gap``) of the bins that hold rows (A3, A4).

    There are at most as many bins as rows. Fixed bins are equally wide; adaptive ones hold equally many rows in the order of (confidence, ``_pos``): bin = floor(rank * bins / rows).
    """
    rows = facts.agg(F.count(F.lit(1)).alias("_n"))
    if adaptive:
        counts = facts.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
        place = facts.join(running(counts, "confidence", {"below": "n"}).select("confidence", "below"), "confidence").withColumn("_r", F.row_number().over(Window.partitionBy("confidence").orderBy("_pos")) - 1 + F.col("below"))
        binned = place.crossJoin(F.broadcast(rows)).withColumn("bin", F.floor(F.col("_r") * F.least(F.lit(bins), F.col("_n")) / F.col("_n")))
    else:
        b = F.least(F.lit(bins), F.col("_n"))
        binned = facts.crossJoin(F.broadcast(rows)).withColumn("bin", F.least(b - 1, F.floor(F.col("confidence") * b)))
    each = binned.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg("outcome").alias("accuracy"))
    return each.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """``ece``: mean gap weighted by counts (A5)."""
    return bins.agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"))


def auroc(facts: DataFrame, score: str = "confidence") -> DataFrame:
    """``auroc`` with average ranks for ties (A6, W1); null if there is one class only."""
    ranks = _ranked(facts, score)
    positives, rows = F.sum("hits"), F.sum("n")
    rank_sum = F.sum(F.col("hits") * (F.col("below") + (F.col("n") + 1) / 2))
    return ranks.agg(F.when((positives > 0) & (rows > positives), (rank_sum - positives * (positives + 1) / 2) / (positives * (rows - positives))).alias("auroc"))


def with_average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """With the mean rank of equal values, from 1."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranks = running(counts, value, {"below": "n"}).select(value, (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``spearman``: Pearson's correlation of average ranks (W2); null for a constant side or fewer than two rows."""
    ranked = with_average_rank(with_average_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(F.when((F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0), F.corr("_ra", "_rb")).alias("spearman"))


def _ordered(facts: DataFrame, score: str = "confidence") -> DataFrame:
    """``facts`` with ``_place`` (from 1) and ``_hits`` (of outcomes up to the row) in the order (-score, ``_pos``)."""
    counts = facts.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("hits"))
    above = running(counts, score, {"_above": "n", "_hits_above": "hits"}, descending=True).select(score, "_above", "_hits_above")
    inside = Window.partitionBy(score).orderBy("_pos")
    return facts.join(above, score).withColumn("_place", F.row_number().over(inside) + F.col("_above")).withColumn("_hits", F.sum("outcome").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_hits_above"))


def risk_coverage(facts: DataFrame) -> DataFrame:
    """(``place``, ``coverage``, ``risk``, ``confidence``) of every prefix in the order of falling confidence."""
    rows = facts.agg(F.count(F.lit(1)).alias("_n"))
    return _ordered(facts).crossJoin(F.broadcast(rows)).select(F.col("_place").alias("place"), (F.col("_place") / F.col("_n")).alias("coverage"), (1 - F.col("_hits") / F.col("_place")).alias("risk"), "confidence")


def risk_area(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg("risk").alias("aurc"))


def thinned(curve: DataFrame, points: int = 100) -> DataFrame:
    """Every so-manieth point, the last always kept."""
    rows = curve.agg(F.max("place").alias("_n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return curve.crossJoin(F.broadcast(rows)).filter(((F.col("place") - 1) % stride == 0) | (F.col("place") == F.col("_n"))).drop("_n")


def false_positives_at_recall(facts: DataFrame, recall: float = 0.95, score: str = "confidence") -> DataFrame:
    """``fpr``: the false positive rate at the first place, in the order (-score, ``_pos``), whose recall reaches ``recall`` (W5). Null if there is one class only."""
    both = facts.agg(F.sum("outcome").alias("_p"), F.count(F.lit(1)).alias("_n"))
    placed = _ordered(facts, score).crossJoin(F.broadcast(both)).filter(F.col("_hits") >= F.col("_p") * recall - 1e-12)
    return placed.agg(F.min_by(F.when((F.col("_p") > 0) & (F.col("_n") > F.col("_p")), (F.col("_place") - F.col("_hits")) / (F.col("_n") - F.col("_p"))), "_place").alias("fpr"))


def selective(facts: DataFrame, thresholds: list[float]) -> DataFrame:
    """(``threshold``, ``coverage``, ``accuracy``): of the rows at or above each threshold (F3); accuracy is null if there are none."""
    each = facts.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "confidence", "outcome")
    kept = F.col("confidence") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col("outcome"))).alias("accuracy"))


def abstained(confidence: Column, threshold: float | None) -> Column:
    return F.lit(False) if threshold is None else F.coalesce(confidence < threshold, F.lit(False))


def confidence_of(source: str) -> Column:
    """The confidence of a generation row by its source, within [0, 1]."""
    by = {
        "single_pass": F.col("calibrated_confidence"),
        "first_token_entropy": F.coalesce("non_special_first_token_confidence", "first_token_confidence"),
        "sequence_probability": F.exp(F.col("sequence_log_probability") / F.greatest(F.col("generated_token_count"), F.lit(1))),
        "provided": F.col("confidence") if source == "provided" else F.lit(None),
    }
    return clipped(by[source])


def seed_summary(long: DataFrame, run: Column) -> DataFrame:
    """(``run``, ``metric``, ``n``, ``mean``, ``std``, ``ci95``) over rows (``metric``, ``value``) of runs that differ by seed (A8, A9); deviations are null for one run."""
    each = long.filter(F.col("value").isNotNull()).groupBy(run.alias("run"), "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("value")).alias("std"))
    return each.withColumn("ci95", 1.96 * F.col("std") / F.sqrt(F.col("n")))


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` between its least and greatest; 0.5 where all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)).drop("_lo", "_hi")


def out_of_distribution(known: DataFrame, foreign: DataFrame) -> DataFrame:
    """One row (K24): AUROC and false positives at 95 % recall of 1 - confidence, AUROC of the distance and of minus the margin, with foreign rows as the positives.

    Both tables: (``confidence``, ``distance``, ``margin``, ``_pos``); known rows come first where scores are equal.
    """
    both = known.select("confidence", "distance", "margin", "_pos", F.lit(0.0).alias("outcome")).unionByName(foreign.select("confidence", "distance", "margin", (F.col("_pos") + (1 << 40)).alias("_pos"), F.lit(1.0).alias("outcome")))
    scored = both.select((1 - F.col("confidence")).alias("doubt"), "distance", (-F.col("margin")).alias("closeness"), "_pos", "outcome")
    out = auroc(scored, "doubt").withColumnRenamed("auroc", "confidence_auroc").crossJoin(false_positives_at_recall(scored, 0.95, "doubt").withColumnRenamed("fpr", "confidence_fpr95"))
    return out.crossJoin(auroc(scored, "distance").withColumnRenamed("auroc", "distance_auroc")).crossJoin(auroc(scored, "closeness").withColumnRenamed("auroc", "margin_auroc"))


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of values times weights by the sum of weights."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
