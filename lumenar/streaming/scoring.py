"""Routing and confidence on a stream. Both are column expressions, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrator import Calibrator
from ..operators.evaluation import abstained
from ..operators.routing import routed


def routed_stream(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` (streaming or not) with the columns of ``routed``; ``centroids`` is a small static table."""
    return routed(vectors, centroids)


def scored_stream(generations: DataFrame, calibrator: Calibrator, threshold: float | None = None) -> DataFrame:
    scored = generations.withColumn("calibrated_confidence", calibrator.confidence())
    return scored.withColumn("abstained", abstained(F.col("calibrated_confidence"), threshold))


def drift(generations: DataFrame, time: str = "created_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Mean confidence, mean distance and abstentions by window of event time; rows later than ``late`` are left out when it is a stream."""
    stamped = generations.withColumn("_t", F.col(time))
    held = stamped.withWatermark("_t", late) if generations.isStreaming else stamped
    return held.groupBy(F.window("_t", window).alias("w")).agg(F.count(F.lit(1)).alias("generations"), F.avg("calibrated_confidence").alias("mean_confidence"), F.avg("routing_distance").alias("mean_distance"), F.avg(F.col("abstained").cast("double")).alias("abstained")).select(F.col("w.start").alias("start"), "generations", "mean_confidence", "mean_distance", "abstained")
