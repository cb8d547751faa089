"""Meaning classes of sampled answers, their entropy, and correctness against references (survey K5-K11, K23, A13-A19, J6-J8, U5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.numeric import best_reference, best_rouge_l, entropy, entropy_confidence, rouge_1, softmax, total
from ..functions.text import semantic_form, semantic_text, stripped, tokens

#: Says of each pair (prompt, a, b) whether a and b mean the same.
Scorer = Callable[[list[tuple[str, str, str]]], list[bool]]


def class_ids(forms: Column) -> Column:
    """Dense ids, by first occurrence, of equal forms in an array (K6 without a scorer, U5)."""
    names = F.array_distinct(forms)
    return F.transform(forms, lambda f: (F.array_position(names, f) - 1).cast("int"))


def scored_class_ids(scorer: Scorer, transitive: bool = False):
    """The same by an injected scorer (K6, K7): each answer against the first of every class so far, or, ``transitive``, all pairs and their closure. Works on one row's few samples."""

    @F.pandas_udf("array<int>")
    def classes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, answers in batches:
            out = []
            for prompt, texts in zip(prompts, answers, strict=True):
                ids: list[int] = []
                if transitive:
                    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
                    same = dict(zip(pairs, scorer([(prompt, texts[i], texts[j]) for i, j in pairs]), strict=True)) if pairs else {}
                    root = list(range(len(texts)))
                    find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
                    for (i, j), equal in same.items():
                        if equal:
                            a, b = sorted((find(i), find(j)))
                            root[b] = a
                    order: dict[int, int] = {}
                    ids = [order.setdefault(find(i), len(order)) for i in range(len(texts))]
                else:
                    firsts: list[str] = []
                    for t in texts:
                        hits = scorer([(prompt, f, t) for f in firsts]) if firsts else []
                        if len(hits) != len(firsts):
                            raise ValueError("a scorer must answer each pair")
                        at = next((i for i, h in enumerate(hits) if h), len(firsts))
                        if at == len(firsts):
                            firsts.append(t)
                        ids.append(at)
                out.append(ids)
            yield pd.Series(out, dtype=object)

    return classes


def class_probabilities(ids: Column, log_probabilities: Column | None = None) -> Column:
    """The weight of each class: its share of samples, or the softmax of the samples' log-probabilities summed by class (A13); minus infinity weighs nothing."""
    weights = softmax(log_probabilities) if log_probabilities is not None else F.transform(ids, lambda _: F.lit(1.0) / F.size(ids))
    both = F.arrays_zip(ids.alias("i"), weights.alias("w"))
    return F.transform(F.array_distinct(ids), lambda c: total(F.transform(F.filter(both, lambda z: z["i"] == c), lambda z: z["w"])))


def semantic_entropy(ids: Column, log_probabilities: Column | None = None, normalize: bool = False) -> Column:
    """Entropy of the classes, by the log of their number if ``normalize`` (A15); one class has none."""
    p = class_probabilities(ids, log_probabilities)
    h = entropy(p)
    return F.when(F.size(p) <= 1, 0.0).otherwise(h / F.ln(F.size(p).cast("double"))) if normalize else h


def rao_entropy(ids: Column, log_probabilities: Column) -> Column:
    """Minus the mean, over classes, of the log of their summed probability (A16); infinite if a class has none."""
    both = F.arrays_zip(ids.alias("i"), log_probabilities.alias("w"))

    def log_sum(c: Column) -> Column:
        own = F.transform(F.filter(both, lambda z: z["i"] == c), lambda z: z["w"])
        top = F.array_max(own)
        return F.when(top == float("-inf"), top).otherwise(top + F.ln(total(F.transform(own, lambda w: F.exp(w - top)))))

    names = F.array_distinct(ids)
    return -total(F.transform(names, log_sum)) / F.size(names)


def semantic_confidence(ids: Column, log_probabilities: Column | None = None, mode: str = "max") -> Column:
    """The weight of the largest class, or the confidence of the entropy (K5)."""
    p = class_probabilities(ids, log_probabilities)
    return F.array_max(p) if mode == "max" else entropy_confidence(entropy(p), F.size(p), mode)


def semantic_rows(samples: DataFrame, key: str = "example_id") -> DataFrame:
    """One row per example of several sampled answers: (``key``, ``samples``, ``classes``, ``entropy``, ``weighted_entropy``, ``rao_entropy``, ``confidence``).

    ``samples``: (``key``, ``text``, ``log_probability``, ``_pos``). A row's samples are few (10 by default), so they are gathered in its array. Weighted measures are null where a
    log-probability is missing: all samples have one or none counts.
    """
    each = samples.filter(F.col(key).isNotNull()).select(key, "_pos", semantic_text(F.col("text")).alias("form"), "log_probability")
    gathered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "form", F.col("log_probability").alias("lp")))).alias("s"))
    lp = F.transform("s", lambda x: x["lp"])
    held = gathered.withColumn("ids", class_ids(F.transform("s", lambda x: x["form"]))).withColumn("lp", F.when(F.forall(lp, lambda x: x.isNotNull()), lp))
    ids = F.col("ids")
    return held.select(key, F.size("s").alias("samples"), F.size(F.array_distinct("ids")).alias("classes"), semantic_entropy(ids).alias("entropy"), semantic_entropy(ids, F.col("lp")).alias("weighted_entropy"), rao_entropy(ids, F.col("lp")).alias("rao_entropy"), semantic_confidence(ids).alias("confidence"))


@F.pandas_udf(BooleanType())
def _same_form(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for predictions, references in batches:
        yield pd.Series([p is not None and r is not None and semantic_form(p) in {semantic_form(x) for x in r if x is not None} for p, r in zip(predictions, references, strict=True)], dtype=bool)


def correct(prediction: Column, references: Column, mode: str = "semantic", threshold: float = 0.5) -> Column:
    """1 if a prediction agrees with any reference (K10, K11, J8): by equal semantic form, or by a ROUGE F1 of at least ``threshold``."""
    if mode == "semantic":
        plain = lambda t: F.regexp_replace(F.lower(stripped(t)), r"\s+", " ")
        ascii_only = ~F.coalesce(F.concat(prediction, F.array_join(references, " ")), F.lit("")).rlike(r"[^\x00-\x7F]")
        held = prediction.isNotNull() & references.isNotNull()
        return F.when(~held, None).when(ascii_only, F.exists(references, lambda r: r.isNotNull() & (plain(r) == plain(prediction)))).otherwise(_same_form(prediction, references)).cast("double")
    said, held = tokens(prediction), F.transform(references, lambda r: tokens(r))
    best = {"rouge_1": lambda: best_reference(rouge_1, said, held), "rouge_l": lambda: best_rouge_l(said, held)}[mode]()
    return (best >= threshold).cast("double")


def mean_entropy_by_position(trajectories: DataFrame, values: str = "entropies") -> DataFrame:
    """(``position``, ``mean``, ``count``) over arrays of different lengths (A18, A19); numbers that aren't finite count nowhere."""
    each = trajectories.select(F.posexplode(values).alias("position", "h"))
    fine = F.col("h").isNotNull() & ~F.isnan("h") & (F.abs("h") != float("inf"))
    return each.groupBy("position").agg(F.avg(F.when(fine, F.col("h"))).alias("mean"), F.count(F.when(fine, 1)).alias("count"))
