"""Filling containers of fixed capacity with texts (problem 7): bounded-space online packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Open containers per partition and capacity.
WINDOWS = 64


class OpenWindows:
    """At most ``windows`` open containers. An item goes where least room is left; where it fits nowhere, a new container is opened, for which the fullest of too many is closed."""

    def __init__(self, capacity: int, windows: int, name: str):
        self.capacity, self.windows, self.name, self.opened = capacity, windows, name, 0
        self.room: list[tuple[int, str]] = []  # by the room left

    def place(self, size: int) -> str:
        at = bisect_left(self.room, (size, ""))
        if at < len(self.room):
            left, container = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                self.room.pop(0)
            left, container = self.capacity, f"{self.name}-{self.opened}"
            self.opened += 1
        if left > size:
            insort(self.room, (left - size, container))
        return container


def pieces(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """(``pack_name``, ``capacity``, ``doc_id``, ``piece``, ``size``): a text larger than the capacity is cut into full pieces and a rest, any other is one piece; texts without tokens give none."""
    cut = sized.filter("tokens > 0").crossJoin(F.broadcast(capacities.filter("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").alias("capacity")).dropDuplicates(["pack_name"])))
    last = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")
    each = cut.select("pack_name", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return each.select("pack_name", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))


def _pack(level: str, windows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: dict[str, OpenWindows] = {}
        for rows in batches:
            containers = []
            for name, capacity, size in zip(rows["pack_name"], rows["capacity"], rows["size"], strict=True):
                if name not in state:
                    state[name] = OpenWindows(int(capacity), windows, f"{name}-{level}{part}")
                containers.append(state[name].place(int(size)))
            yield rows.assign(container=containers)

    return pack


def packed_texts(sized: DataFrame, capacities: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(``pack_name``, ``container``, ``doc_id``, ``piece``, ``size``, ``fill``): every piece of every text in a container of each capacity; ``fill`` is the container's tokens by its capacity.

    Texts are spread evenly over partitions by their hashes and taken in that order, so a repeated run packs alike. Each task keeps ``windows`` open containers per capacity and nothing
    else. Containers that are at most half full at the end (as a rule not more than the open ones, ``windows`` for each partition and capacity) are merged: whole containers are placed
    like items, largest first, in a tree: 16 groups become one at each level. A task leaves one container of each capacity at most half full, or its open ones, so no task gets more than 16 groups' few. ``capacities`` is a small table, broadcast. No text is lost or split unless it is larger than the capacity; empty tables give no rows.
    """
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("doc_id")
    items = pieces(sized, capacities).repartition(parts, "doc_id").sortWithinPartitions(order, "doc_id", "pack_name", "piece")
    placed = cut_lineage(items.mapInPandas(_pack("", windows), "pack_name string, capacity int, doc_id bigint, piece int, size int, container string"))
    filled = placed.groupBy("pack_name", "capacity", "container").agg(F.sum("size").cast("int").alias("size"))
    loose = filled.filter(F.col("size") * 2 <= F.col("capacity"))
    merged, groups, level = None, parts, "a"
    while merged is None or groups > 1:
        groups = max(1, groups // 16)
        again = loose.repartition(groups, F.xxhash64(F.regexp_extract("container", r"-(\D*\d+)-\d+$", 1))).sortWithinPartitions("pack_name", F.desc("size"), "container")
        into = cut_lineage(again.withColumnRenamed("container", "was").mapInPandas(_pack(level, 4 * windows), "pack_name string, capacity int, was string, size int, container string"))
        merged = into.select("pack_name", "was", "container") if merged is None else merged.join(into.select("pack_name", F.col("was").alias("container"), F.col("container").alias("now")), ["pack_name", "container"], "left").select("pack_name", "was", F.coalesce("now", "container").alias("container"))
        loose = into.groupBy("pack_name", "capacity", "container").agg(F.sum("size").cast("int").alias("size")).filter(F.col("size") * 2 <= F.col("capacity"))
        level = chr(ord(level) + 1)
    moved = placed.withColumnRenamed("container", "was").join(merged, ["pack_name", "was"], "left").select("pack_name", "capacity", F.coalesce("container", "was").alias("container"), "doc_id", "piece", "size")
    fill = moved.groupBy("pack_name", "container").agg((F.sum("size") / F.first("capacity")).alias("fill"))
    return moved.join(fill, ["pack_name", "container"]).select("pack_name", "container", "doc_id", "piece", "size", "fill")


def pack_report(packed: DataFrame) -> DataFrame:
    """(``pack_name``, ``containers``, ``pieces``, ``tokens``, ``mean_fill``) per capacity."""
    each = packed.groupBy("pack_name", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.first("fill").alias("fill"))
    return each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("size").alias("tokens"), F.avg("fill").alias("mean_fill"))
