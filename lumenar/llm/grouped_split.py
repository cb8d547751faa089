"""Splits that keep related records together (problem 4).

Records that share any entity form components (large-star, small-star); a component's hash falls into one of three ranges as wide as the wanted proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_split
from .components import connected_components


def group_name(group_id: Column) -> Column:
    """Lower case, parts joined by single hyphens, no blanks; null where nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(group_id), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.nullif(name, F.lit(""))


def _node(kind: str, value: Column) -> Column:
    """64-bit name of an entity; null for a null one."""
    return F.when(value.isNotNull(), F.xxhash64(F.lit(kind), value))


def entity_components(records: DataFrame, entities: dict[str, Column]) -> DataFrame:
    """``records`` with ``component`` (bigint): equal for all records joined by a chain of equal entities.

    ``entities``: columns over ``records`` by kind; a null entity joins nothing, and a record without any is null in ``component``. The graph is drawn between entities, not records: a
    record names its first entity the neighbour of its others, repeats are dropped before the shuffle, so a group of any number of records costs one edge for each pair of entities it
    really shows. Memory: nothing is collected.
    """
    nodes = [_node(kind, value) for kind, value in entities.items()]
    marked = records.withColumn("_first", F.coalesce(*nodes))
    edges = marked.select("_first", F.explode(F.array(*nodes)).alias("v")).filter("v is not null").select(F.col("_first").alias("u"), "v").distinct()
    labels = connected_components(edges).withColumnRenamed("node", "_first")
    return marked.join(labels, "_first", "left").drop("_first")


def split_audit(records: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups and how the recorded split divides them: (``group_id``, ``examples``, ``train``, ``validation``, ``test``, ``splits``), one row per group.

    The spellings of a group id are entities of their own beside its plain name, so the components join all spellings. Records are counted by spelling and split before any shuffle of
    rows; null and blank ids are no groups; names that are no split count in ``examples`` only. Empty input gives no rows.
    """
    spelled = records.groupBy(F.col(group).alias("_spelling"), read_split(F.col(split)).alias("_split")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_name", group_name(F.col("_spelling"))).filter("_name is not null")
    joined = entity_components(spelled, {"spelling": F.col("_spelling"), "name": F.col("_name")})
    counts = [F.sum(F.when(F.col("_split") == s, F.col("_n")).otherwise(0)).alias(s) for s in ("train", "validation", "test")]
    per = joined.groupBy("component").agg(F.min("_name").alias("group_id"), F.sum("_n").alias("examples"), *counts)
    return per.select("group_id", "examples", "train", "validation", "test", sum((F.col(s) > 0).cast("int") for s in ("train", "validation", "test")).alias("splits"))


def assign_splits(records: DataFrame, config: DataFrame, key: str = "example_id", group: str = "group_id", dataset: Column | None = None) -> DataFrame:
    """One row per record key: (``example_id``, ``dataset``, ``component``, ``assigned_split``).

    ``config`` (one small row per dataset, ``data_config``) gives train_ratio, validation_ratio, test_ratio, split_seed. Repeated rows of a key count once; a record whose group is null
    is its own component, whatever ``split_unit`` says, and one with a group goes with its group. A component that alone holds more than half of the smallest split's share of its dataset
    goes to train (there are at most 2 / ratio of those), and the ranges of the others shrink to fit; so a group of a third of all rows neither upsets a small split nor is divided.
    Records of a dataset without configuration get null.
    """
    dataset = dataset if dataset is not None else F.regexp_extract(F.col(key), r"^([^-]+)-", 1)
    keyed = records.select(F.col(key).alias("example_id"), group_name(F.col(group)).alias("_name"), F.col(group).alias("_spelling"), dataset.alias("dataset")).filter("example_id is not null")
    keyed = keyed.groupBy("example_id").agg(F.min(F.struct("dataset", "_name", "_spelling")).alias("_r")).select("example_id", "_r.*")
    units = entity_components(keyed, {"spelling": F.col("_spelling"), "name": F.col("_name")}).withColumn("component", F.coalesce("component", F.xxhash64(F.lit("record"), F.col("example_id"))))
    sizes = units.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("dataset").agg(F.sum("n").alias("all"))
    wanted = config.select(F.col("name").alias("dataset"), "train_ratio", "validation_ratio", "test_ratio", "split_seed").dropDuplicates(["dataset"])
    smallest = F.least("validation_ratio", "test_ratio")
    judged = sizes.join(F.broadcast(totals.join(F.broadcast(wanted), "dataset")), "dataset", "left").withColumn("giant", F.coalesce(F.col("n") > F.col("all") * smallest / 2, F.lit(False)) & (F.col("n") > 1))
    rest = judged.groupBy("dataset").agg(F.sum(F.when(~F.col("giant"), F.col("n")).otherwise(0)).alias("rest"))
    ranged = judged.join(rest, "dataset", "left")
    u = F.pmod(F.xxhash64("split_seed", "component"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    width = F.col("all") / F.greatest(F.col("rest"), F.lit(1))
    test, validation = F.col("test_ratio") * width, F.col("validation_ratio") * width
    chosen = F.when(F.col("all").isNull(), F.lit(None)).when(F.col("giant"), "train").when(u < test, "test").when(u < test + validation, "validation").otherwise("train")
    return units.join(ranged.select("dataset", "component", chosen.alias("assigned_split")), ["dataset", "component"], "left").select("example_id", "dataset", "component", "assigned_split")
