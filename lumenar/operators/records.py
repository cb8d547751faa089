"""Canonical examples from conversations, and their splits (survey X1-X8, F5, L7, D1-D3, U6, W6, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import allocation_counts, distinct_texts, fallback_id, first_identifier, prompt_text, split_name, stripped

# The order in which raw splits are traversed.
SPLIT_ORDER = ("train", "validation", "dev", "val", "test", "all")
#: Bytes of a group's joined responses above which its rows are dealt out, and of all such texts that are broadcast at most.
LONG_TEXT, LONG_TEXTS = 1 << 18, 1 << 26


def first_delivery(df: DataFrame, key: str, order: tuple[str, ...] = ("ingested_at", "_pos")) -> DataFrame:
    """The earliest row of each key; rows of a null key are left out."""
    least = F.min_by(F.struct(*df.columns), F.struct(*order))  # combined before the shuffle, so whole rows of repeats aren't sorted
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(least.alias("_row")).select("_row.*")


def canonical_examples(df: DataFrame) -> DataFrame:
    """Rows that are prompt and response already (X1): the group falls back to the id, references are the response and the others without repeats."""
    refs = distinct_texts(F.concat(F.array("response"), F.coalesce(F.col("references"), F.array().cast("array<string>"))))
    return df.select("example_id", stripped(F.col("prompt")).alias("prompt"), stripped(F.col("response")).alias("response"), refs.alias("references"), "split", first_identifier(F.col("group_id"), F.col("example_id")).alias("group_id"), "cluster_id", "metadata")


def _example(df: DataFrame, dataset: str, group: Column, turn_id: Column, context: Column, question: Column, history: Column, answers: Column, metadata: Column) -> DataFrame:
    refs = distinct_texts(answers)
    return df.select(turn_id.alias("example_id"), prompt_text(dataset, context, question, history).alias("prompt"), F.get(refs, F.lit(0)).alias("response"), refs.alias("references"), "split", group.alias("group_id"), metadata.alias("metadata"), F.col("turn").alias("turn")).filter("response is not null")


def expand_coqa(df: DataFrame, use_history: bool = False) -> DataFrame:
    """One example per turn (X2, X3). ``df``: id, source, story, questions array<string>, answers struct<input_text array<string>>, additional_answers map<string, array<struct<input_text>>>, split.

    The history is cut from the dialogue's own lists before they are exploded, so no window and no shuffle is needed. Additional answers out of range are skipped.
    """
    turns = F.arrays_zip(F.col("questions").alias("question"), F.col("answers.input_text").alias("answer"))
    rows = df.withColumn("_turns", turns).select("*", F.posexplode("_turns").alias("turn", "_t"))
    more = F.transform(F.map_values(F.coalesce("additional_answers", F.create_map().cast("map<string,array<struct<input_text:string>>>"))), lambda a: F.try_element_at(a, F.col("turn") + 1)["input_text"])
    group = first_identifier(F.col("id"), fallback_id(F.lit("coqa"), F.col("split"), F.lit(0), F.col("story")))
    history = F.transform(F.slice("_turns", 1, F.col("turn")), lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer"))) if use_history else None
    return _example(rows, "coqa", group, F.concat(group, F.lit(":turn-"), F.lpad(F.col("turn").cast("string"), 3, "0")), F.col("story"), F.col("_t.question"), history, F.concat(F.array("_t.answer"), more), F.create_map(F.lit("dataset"), F.lit("coqa"), F.lit("turn"), F.col("turn").cast("string")))


def expand_quac(df: DataFrame, use_history: bool = False) -> DataFrame:
    """As for coqa (X4, X5): dialogue_id, context, questions, turn_ids, answers array<struct<texts>>, orig_answers struct<texts>, split; the original answer stands first."""
    zipped = F.arrays_zip(F.col("questions").alias("question"), F.col("turn_ids").alias("turn_id"))
    rows = df.withColumn("_turns", zipped).select("*", F.posexplode("_turns").alias("turn", "_t"))
    original = F.try_element_at(F.col("orig_answers.texts"), F.col("turn") + 1)
    others = F.coalesce(F.try_element_at(F.col("answers"), F.col("turn") + 1)["texts"], F.array().cast("array<string>"))
    group = first_identifier(F.col("dialogue_id"), fallback_id(F.lit("quac"), F.col("split"), F.lit(0), F.col("context")))
    turn_id = first_identifier(F.col("_t.turn_id"), F.concat(group, F.lit(":turn-"), F.lpad(F.col("turn").cast("string"), 3, "0")))
    history = F.transform(F.slice("_turns", 1, F.col("turn")), lambda t, i: F.struct(t["question"].alias("question"), F.try_element_at(F.col("orig_answers.texts"), i + 1).alias("answer"))) if use_history else None
    return _example(rows, "quac", group, turn_id, F.col("context"), F.col("_t.question"), history, F.concat(F.array(original), others), F.create_map(F.lit("dataset"), F.lit("quac"), F.lit("turn"), F.col("turn").cast("string")))


def expand_xsum(df: DataFrame, position: str | None = None) -> DataFrame:
    """One example per document (X6): id, document, summary, split. Rows without document or summary are left out."""
    key = first_identifier(F.col("id"), fallback_id(F.lit("xsum"), F.col("split"), F.col(position) if position else F.lit(0), F.col("document")))
    rows = df.filter((stripped(F.col("document")) != "") & (stripped(F.col("summary")) != ""))
    return rows.select(key.alias("example_id"), prompt_text("xsum", F.col("document")).alias("prompt"), stripped(F.col("summary")).alias("response"), distinct_texts(F.array("summary")).alias("references"), "split", key.alias("group_id"), F.create_map(F.lit("dataset"), F.lit("xsum")).alias("metadata"))


def limited(df: DataFrame, most: int | None, split: str = "split", order: tuple[str, ...] = ("_pos",)) -> DataFrame:
    """The first ``most`` examples in the order of splits, then of position (X8, L1); None keeps all."""
    if most is None:
        return df
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.lower(F.col(split))).cast("int"), F.lit(0))
    return df.withColumn("_rank", F.when(rank == 0, len(SPLIT_ORDER) + 1).otherwise(rank)).orderBy("_rank", F.col(split), *order).limit(most).drop("_rank")


def duplicate_ids(df: DataFrame, key: str = "example_id") -> DataFrame:
    """Ids of more than one row (F5), at most five; a split refuses such input."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").orderBy(key).limit(5)


def deterministic_split(examples: DataFrame, ratios: dict[str, float], seed: int = 2026, unit: str = "group") -> DataFrame:
    """``examples`` with ``split`` set (D1): whole units, in the order of a salted SHA-256, fill the splits with exact largest-remainder counts; input order plays no part.

    Units are numbered without one global sort task: they are counted by the first digits of their hash (as many as leave about 100,000 units to a bucket), and numbered within a bucket behind
    the buckets before it. Only the number of units reaches the driver. Ids of more than one row raise.
    """
    if repeated := [r["example_id"] for r in duplicate_ids(examples).collect()]:
        raise ValueError(f"ids of more than one row: {', '.join(map(str, repeated))}")
    key = F.col("group_id" if unit == "group" else "example_id")
    units = examples.select(key.alias("_unit")).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "_unit"), 256))
    total = units.count()
    counts = allocation_counts(total, ratios)
    digits = 1
    while total > 100_000 * 16**digits:
        digits += 1
    units = units.withColumn("_b", F.substring("_h", 1, digits))
    sizes = units.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_unit")) + F.col("_before")
    chosen, upto = None, 0
    for name, n in counts.items():
        upto += n
        chosen = F.when(F.col("_place") <= upto, name) if chosen is None else chosen.when(F.col("_place") <= upto, name)
    assigned = units.join(F.broadcast(before), "_b").withColumn("_place", place).select("_unit", chosen.alias("_split"))
    return examples.withColumn("_unit", key).join(assigned, "_unit", "left").drop("_unit", "split").withColumnRenamed("_split", "split")


def expanded(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows of one table as examples (X7): those that are prompt and response already pass through, of the others a dataset's own shape is expanded (documents with summaries here; dialogues by ``expand_coqa`` and ``expand_quac``, whose columns differ)."""
    ready = F.col("prompt").isNotNull() & F.col("response").isNotNull()
    whole = canonical_examples(rows.filter(ready)).drop("cluster_id")
    if dataset != "xsum":
        return whole
    others = expand_xsum(rows.filter(~ready))
    return whole.unionByName(others.select(whole.columns))


def split_examples(examples: DataFrame, ratios: dict[str, float], seed: int = 2026, unit: str = "group", official: bool = False) -> DataFrame:
    """The recorded splits, or deterministic ones."""
    return official_split(examples) if official else deterministic_split(examples, ratios, seed, unit)


def prepare(examples: DataFrame, path: str, ratios: dict[str, float], seed: int = 2026, unit: str = "group", official: bool = False, again: bool = False) -> dict[str, int]:
    """Splits examples and writes them, unless all three splits stand at ``path`` already (D3, S8); rows by split. A split without rows has an empty folder."""
    from ..sources.records import prepared, write_splits

    spark = examples.sparkSession
    if again or not prepared(path):
        write_splits(split_examples(examples, ratios, seed, unit, official), path)
    counts = {r.split: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    return {s: counts.get(s, 0) for s in ("train", "validation", "test")}


def official_split(examples: DataFrame) -> DataFrame:
    """The recorded split by its aliases (U6); names that are none of the three raise."""
    return examples.withColumn("split", split_name(F.col("split"), allow_all=False))


def with_history(df: DataFrame, group: Column, turn: Column) -> DataFrame:
    """``df`` with ``history``: the responses of the turns before each in its group, oldest first (W6), and ``turn_number``. For turns that are rows; use ``expand_*`` where a dialogue is one row."""
    w = Window.partitionBy(group).orderBy(turn, "example_id")
    return df.withColumn("turn_number", F.row_number().over(w) - 1).withColumn("history", F.collect_list(F.coalesce("response", F.lit(""))).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def with_history_text(df: DataFrame, group: str, turn: str, between: str = "|") -> DataFrame:
    """As ``with_history``, with ``history`` as one text, ``between`` between the responses. Rows of a null group are left out.

    The text of a group is joined once and cut for each of its rows, so no list of earlier responses is built for a row, and nothing is shuffled but the rows. They come by groups and turns, so
    each history begins with the one before, which an encoding by common beginnings (Parquet's DELTA_BYTE_ARRAY) keeps in proportion to the input. Not so the rows of groups whose text is longer
    than ``LONG_TEXT``: these are dealt out among all other rows and tasks, because a Parquet writer holds 100 values before it looks at their size, and one task would write most of the result.
    Their texts are broadcast, so this holds up to ``LONG_TEXTS`` bytes of them; beyond that their rows stay with their group.
    """
    w = Window.partitionBy(group).orderBy(turn, "example_id", "_said")
    gap = F.lit(len(between.encode()))
    said = df.filter(F.col(group).isNotNull()).withColumn("_said", F.coalesce("response", F.lit("")))
    length = F.octet_length("_said") + gap
    before = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = said.withColumn("turn_number", F.row_number().over(w) - 1).withColumn("_end", F.greatest(F.coalesce(before, gap) - gap, F.lit(0)).cast("int"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "_said"))), lambda x: x["_said"])
    texts = placed.groupBy(group).agg(F.array_join(in_order, between).cast("binary").alias("_text"))
    most = LONG_TEXTS // LONG_TEXT
    long = said.groupBy(group).agg(F.sum(length).alias("n")).filter(F.col("n") > LONG_TEXT).limit(most + 1).collect()
    if long and len(long) <= most and sum(r["n"] for r in long) <= LONG_TEXTS:
        is_long = F.col(group).isin([r[group] for r in long])
        at = F.when(is_long, F.xxhash64(group, "example_id", "turn_number")).otherwise(F.xxhash64(group))
        dealt = placed.withColumn("_at", at).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_at", group)  # a number that is named is not lessened for the small rows
        short = texts.filter(~is_long).withColumn("_at", F.xxhash64(group))
        whole = texts.filter(is_long).select(group, F.col("_text").alias("_long"))
        both = dealt.join(short.hint("merge"), ["_at", group], "left").join(F.broadcast(whole), group, "left").withColumn("_text", F.coalesce("_text", "_long"))
    else:
        both = placed.join(texts.hint("merge"), group)
    return both.select(*df.columns, "turn_number", F.substring("_text", F.lit(1), F.col("_end")).cast("string").alias("history"))
