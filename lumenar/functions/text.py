"""Text functions as column expressions (survey P1-P16, L8). Null text counts as empty unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Aliases of split and dataset names, prompt templates.
SPLIT_ALIASES = {"train": "train", "training": "train", "validation": "validation", "valid": "validation", "val": "validation", "dev": "validation", "test": "test", "testing": "test"}
WHOLE = ("", "all", "unspecified")
DATASET_ALIASES = {"coqa": "coqa", "stanfordnlp/coqa": "coqa", "quac": "quac", "allenai/quac": "quac", "xsum": "xsum", "edinburghnlp/xsum": "xsum"}
CONTEXT_LABELS = {"coqa": "Story", "quac": "Context", "xsum": "Document"}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def stripped(text: Column) -> Column:
    """Without outer white space of any kind; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def split_name(name: Column, allow_all: bool = True, strict: bool = True) -> Column:
    """train, validation, test or, if allowed, all (P1). Any other name raises, or gives null where ``strict`` is false."""
    plain = F.lower(stripped(name))
    known = _lookup(SPLIT_ALIASES | (dict.fromkeys(WHOLE, "all") if allow_all else {}), plain)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("Unknown split: "), plain)).cast("string")) if strict else known


def dataset_name(name: Column) -> Column:
    """coqa, quac or xsum (P2); any other name raises."""
    plain = F.lower(stripped(name))
    return F.coalesce(_lookup(DATASET_ALIASES, plain), F.raise_error(F.concat(F.lit("Unknown dataset: "), plain)).cast("string"))


def distinct_texts(texts: Column) -> Column:
    """Stripped, without empty ones, each at its first place only."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), stripped), lambda t: t != ""))


def fallback_id(dataset: Column, split: Column, index: Column, text: Column) -> Column:
    """``dataset-`` and 16 hexadecimal digits of the SHA-1 of the parts joined by zero bytes."""
    zero = F.expr("decode(X'00', 'UTF-8')")
    return F.concat(dataset, F.lit("-"), F.substring(F.sha1(F.concat_ws("", dataset, zero, split, zero, index.cast("string"), zero, text)), 1, 16))


def prompt_text(dataset: str, context: Column, question: Column | None = None, history: Column | None = None) -> Column:
    """The prompt of a dataset (P10, P11). ``history``: array of structs (question, answer), told before the question. Summaries take neither question nor history."""
    label = CONTEXT_LABELS[dataset]
    if dataset == "xsum":
        if question is not None or history is not None:
            raise ValueError("xsum takes neither question nor history")
        return F.concat(F.lit(f"{label}: "), stripped(context), F.lit("\nSummary:"))
    if question is None:
        raise ValueError(f"{dataset} requires a question")
    told = F.lit("")
    if history is not None:
        told = F.array_join(F.transform(history, lambda h: F.concat(F.lit("Question: "), stripped(h.question), F.lit("\nAnswer: "), stripped(h.answer), F.lit("\n"))), "")
    return F.concat(F.lit(f"{label}: "), stripped(context), F.lit("\n"), told, F.lit("Question: "), stripped(question), F.lit("\nAnswer:"))


def tokens(text: Column, ascii_only: bool = False) -> Column:
    """Runs of letters or digits in small letters (P13); ``ascii_only`` keeps a-z and 0-9 alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)" if ascii_only else r"([\p{L}\p{N}]+)"), F.lit(1))


def semantic_form(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def _semantic_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else semantic_form(t))


def semantic_text(text: Column) -> Column:
    """Compatibility form, case folded, white space collapsed (P12). ASCII text stays in the JVM."""
    plain = F.regexp_replace(F.lower(stripped(text)), r"\s+", " ")
    return F.when(text.isNull() | ~text.rlike(r"[^\x00-\x7F]"), plain).otherwise(_semantic_form(text))


def statement(answer: Column, prompt: Column) -> Column:
    """The answer as a statement for entailment."""
    joint = F.when(prompt.endswith("Answer:") | prompt.endswith("Summary:"), F.lit(" ")).otherwise(F.lit("\n\nAnswer: "))
    return F.concat(prompt, joint, stripped(answer))


def folder_name(name: Column) -> Column:
    """Safe for a folder."""
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[._-]+|[._-]+$", "")
    return F.when(F.coalesce(safe, F.lit("")) == "", "experiment").otherwise(safe)


def without_seed(run: Column, pattern: str = r"_s\d+$") -> Column:
    return F.regexp_replace(run, pattern, "")


def first_present(*columns: Column) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)


def first_identifier(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(stripped(c.cast("string")), F.lit("")) for c in columns])


def allocation_counts(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole counts by largest remainder; equal remainders go to the earlier name."""
    if total < 0 or any(r < 0 for r in ratios.values()) or sum(ratios.values()) <= 0:
        raise ValueError("a count and ratios of at least 0 with a positive sum are needed")
    weight = sum(ratios.values())
    exact = {k: total * r / weight for k, r in ratios.items()}
    counts = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: -(exact[k] - counts[k]))[: total - sum(counts.values())]:
        counts[k] += 1
    return counts
