"""Language labels as they are written, and a bounded sample of labelled texts to train on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import CODES, LANGUAGES


def read_label(lang: Column) -> Column:
    """One of the five codes; '' for null and placeholders; ``other`` for any other label."""
    plain = F.lower(F.regexp_replace(F.coalesce(lang, F.lit("")), r"(?U)^[\s]+|[\s]+$", ""))
    names = F.create_map(*[F.lit(x) for code, ways in LANGUAGES.items() for way in ways for x in (way, code)])
    known = F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, F.regexp_extract(plain, r"^([^-_]+)[-_]", 1)))
    missing = ~plain.rlike(r"\p{L}") | plain.isin("n/a", "na", "unknown", "und", "none", "null", "unk", "undefined", "xx", "zxx", "mul")
    return F.when(known.isNotNull(), known).when(missing, "").otherwise("other")


def labelled_sample(documents: DataFrame, rows: int, longest: int = 20000, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` whole texts, none longer than ``longest`` letters, with the number of their label's language: those whose ids hash lowest, as many of each language as there are."""
    labelled = documents.select(F.xxhash64(F.lit(seed), "doc_id").alias("h"), "text", read_label(F.col("lang")).alias("label")).filter(F.col("label").isin(*CODES) & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    drawn = [r for code in CODES for r in labelled.filter(F.col("label") == code).orderBy("h").limit(rows // len(CODES)).collect()]
    return [r.text for r in drawn], np.array([CODES.index(r.label) for r in drawn], dtype=np.int64)
