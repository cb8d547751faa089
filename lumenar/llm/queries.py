"""The queries of this package and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import broken_pairs, cut_text, grouped_split, languages, markov_clusters, mixing, packing, parity_sketch, split_overlap, token_sizes
from .common import cut_lineage, table
from .token_sizes import with_tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_text.cut_records(table(spark, sf_dir, "prompt_response"), table(spark, sf_dir, "generated_response"))
    return cut.filter("cut").select("record_table", "record_key")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_text.cut_rates(table(spark, sf_dir, "prompt_response"), table(spark, sf_dir, "generated_response"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, clusters = markov_clusters.cluster_vectors(table(spark, sf_dir, "prompt_vector"))
    return markov_clusters.name_clusters(members, clusters, table(spark, sf_dir, "cluster_centroids"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_clusters.describe_clusters(*markov_clusters.cluster_vectors(table(spark, sf_dir, "prompt_vector")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.found_pairs(table(spark, sf_dir, "prompt_response"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, sf_dir, "prompt_response"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.split_audit(table(spark, sf_dir, "prompt_response")).filter("splits > 1").select("group_id")


def p4_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.assign_splits(table(spark, sf_dir, "prompt_response"), table(spark, sf_dir, "data_config"))


def _stories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "toy_xsum").filter(F.regexp_replace("document", r"(?U)\s+", "") != "")
    return parity_sketch.near_duplicates(rows, "id", F.concat_ws(" ", "document", "summary"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_sketch.key_pairs(*_stories(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_sketch.duplicate_groups(*_stories(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs.broken_pairs(table(spark, sf_dir, "prompt_response"), table(spark, sf_dir, "generated_response"), table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in tokens. A variable that is set but empty, as by one that was never filled in, raises: another count would look like the one asked for."""
    if not token_sizes.TOKENIZER:
        raise ValueError("LUMENAR_TOKENIZER is set but empty: it must name a tokenizer file, or be none to count runs of letters or digits")
    return cut_lineage(with_tokens(table(spark, sf_dir, "documents")))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(_sized(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(p7_packed(spark, sf_dir))


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.mix_report(mixing.mixed_texts(sized, targets), sized, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(table(spark, sf_dir, "documents"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "documents"))


def queries() -> dict:
    all_of = (p1_found, p1_rates, p2_found, p2_clusters, p3_found, p3_report, p4_found, p4_assigned, p5_found, p5_groups, p6_found, p7_packed, p7_report, p8_mixed, p8_shares, p9_found, p9_segments)
    return {f.__name__: f for f in all_of}


_SPLIT = "CASE lower(regexp_replace(split, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' END"


def oracle_sql() -> dict[str, str]:
    """p4 by plain grouping, p5 by counting the common words of all pairs of texts. The others are iterative, learnt or packed, and are tested against brute force or invariants."""
    return {
        "p4_found": f"""WITH named AS (SELECT regexp_replace(regexp_replace(lower(group_id), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g') AS name, {_SPLIT} AS part FROM prompt_response WHERE group_id IS NOT NULL)
SELECT name AS group_id FROM named WHERE name <> '' GROUP BY name HAVING count(DISTINCT part) > 1""",
        "p5_found": """WITH texts AS (SELECT id, min(concat_ws(' ', document, summary)) AS text FROM toy_xsum WHERE id IS NOT NULL AND regexp_replace(document, '[\\s\\x{00A0}]+', '', 'g') <> '' GROUP BY id),
words AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS word FROM texts),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
pairs AS (SELECT a.id AS id_1, b.id AS id_2, count(*) AS shared FROM words a JOIN words b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2)
SELECT id_1, id_2 FROM pairs JOIN sizes x ON x.id = id_1 JOIN sizes y ON y.id = id_2 WHERE shared >= 0.7 * (x.n + y.n - shared) - 1e-9""",
    }
