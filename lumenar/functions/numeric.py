"""Numbers in arrays: distances, softmax, entropy, confidence, token overlap (survey A13-A17, C1-C6, K1-K5, K12-K17, T2-T9, P23, V0)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, summed as squares of differences in double."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(v: Column) -> Column:
    norm = F.greatest(F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x))), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def finite_vector(v: Column, size: int | None = None) -> Column:
    """Present, not empty, of finite numbers and of the given length."""
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(fine & ((F.size(v) == size) if size else F.lit(True)), F.lit(False))


def pooled(states: Column, mask: Column, how: str = "last") -> Column:
    """One vector of an array of token vectors (V0): mean, first or last of those in the mask; first and last of none raise."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["s"])
    if how == "mean":
        width = F.size(states[0])
        return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.greatest(F.size(kept), F.lit(1)))
    at = F.lit(1) if how == "first" else F.size(kept)
    return F.when(F.size(kept) > 0, F.try_element_at(kept, F.greatest(at, F.lit(1)))).otherwise(F.raise_error(F.lit("empty mask")))


def once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    return once(scores, lambda s: once(F.array_max(s), lambda m: once(F.transform(s, lambda x: F.exp(x - m)), lambda e: once(total(e), lambda t: F.transform(e, lambda x: x / t)))))


def router_distribution(distances: Column) -> Column:
    """Softmax of minus the distances by their mean; one expert is certain (C4)."""
    mean = F.greatest(total(distances) / F.size(distances), F.lit(1e-8))
    return F.when(F.size(distances) == 1, F.array(F.lit(1.0))).otherwise(softmax(F.transform(distances, lambda d: -d / mean)))


def entropy(probabilities: Column, base: float | None = None) -> Column:
    """Of probabilities scaled to 1; 0 ln 0 is 0."""
    h = once(probabilities, lambda ps: once(total(ps), lambda mass: -total(F.transform(ps, lambda p: F.when(p > 0, p / mass * F.ln(p / mass)).when(p == 0, 0.0)))))
    return h / F.ln(F.lit(float(base))) if base else h


def categorical_entropy(logits: Column) -> Column:
    return entropy(softmax(logits))


def without_tokens(logits: Column, special: list[int]) -> Column:
    """Logits of all but the special tokens (K3)."""
    return F.filter(logits, lambda _, i: ~i.isin(special)) if special else logits


def entropy_confidence(h: Column, classes: Column | int, mode: str = "exp") -> Column:
    """exp(-H), or 1 - H / ln(classes), within [0, 1]; one class is certain (K4)."""
    n = classes if isinstance(classes, Column) else F.lit(classes)
    raw = F.exp(-h) if mode == "exp" else F.when(n <= 1, 1.0).otherwise(1 - h / F.ln(n.cast("double")))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def clipped(p: Column, least: float = 0.0, most: float = 1.0) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(least)), F.lit(most)))  # least and greatest pass over nulls


def f1(overlap: Column, left: Column, right: Column) -> Column:
    """0 if there is no overlap or a side is empty."""
    return F.when((overlap <= 0) | (left <= 0) | (right <= 0), 0.0).otherwise(2.0 * overlap / (left + right))


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection (U4)."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def rouge_1(a: Column, b: Column) -> Column:
    """F1 of two token arrays."""
    return f1(shared_tokens(a, b), F.size(a), F.size(b))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time."""
    empty = F.transform(b, lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        step = lambda s, i: F.array_append(s, F.when(F.get(b, i) == x, F.when(i > 0, F.get(above, i - 1)).otherwise(0) + 1).otherwise(F.greatest(F.get(above, i), F.when(i > 0, F.get(s, i - 1)).otherwise(0))))
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<int>"), step)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, empty, row), -1))


def rouge_l(a: Column, b: Column) -> Column:
    return f1(common_subsequence(a, b), F.size(a), F.size(b))


def subsequence_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for y in b:
        hit = free & places.get(y, 0)
        free = (free + hit | free - hit) & whole
    return len(a) - free.bit_count()


@F.pandas_udf(DoubleType())
def _best_rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for said, held in batches:
        out = []
        for a, references in zip(said, held, strict=True):
            best = None
            for b in references if references is not None and a is not None else ():
                n = subsequence_length(list(a), list(b))
                best = max(best or 0.0, 2.0 * n / (len(a) + len(b)) if n else 0.0)
            out.append(best)
        yield pd.Series(out, dtype="float64")


def best_rouge_l(prediction: Column, references: Column) -> Column:
    """``best_reference(rouge_l, ...)`` of whole columns in Arrow batches: for texts, where building the table as arrays takes too long."""
    return F.when(F.size(references) > 0, _best_rouge_l(prediction, references)).otherwise(F.raise_error(F.lit("no references")).cast("double"))


def best_reference(score, prediction: Column, references: Column) -> Column:
    """The best score of a prediction's tokens against any reference's (X9, K16); no references raise."""
    return F.when(F.size(references) > 0, F.array_max(F.transform(references, lambda r: score(prediction, r)))).otherwise(F.raise_error(F.lit("no references")).cast("double"))


def generated_length(ids: Column, eos: int, pad: int) -> Column:
    """Tokens up to the first end mark, it included, or else before the first pad."""
    at = F.array_position(ids, eos)
    padded = F.array_position(ids, pad)
    return F.when(at > 0, at).when(padded > 0, padded - 1).otherwise(F.size(ids)).cast("int")


def special_tokens(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(ids)))


def response_labels(prompt: Column, response: Column, prompt_limit: int, response_limit: int, eos: int, left: bool = True, count_eos: bool = True) -> tuple[Column, Column]:
    """Input ids and labels of one row, unpadded (T1-T3): the prompt cut from the left (or right), the response cut so that the end mark fits; -100 where nothing is learnt."""
    cut = F.when(F.size(prompt) > prompt_limit, F.slice(prompt, -prompt_limit, prompt_limit) if left else F.slice(prompt, 1, prompt_limit)).otherwise(prompt)
    said = F.slice(response, 1, response_limit - 1)
    return F.concat(cut, said, F.array(F.lit(eos))), F.concat(F.transform(cut, lambda _: F.lit(-100)), said, F.array(F.lit(eos if count_eos else -100)))


def padded(values: Column, length: Column, fill: int, left: bool = False) -> Column:
    gap = F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0)))
    return F.concat(gap, values) if left else F.concat(values, gap)


def sequence_nll(log_probabilities: Column, labels: Column) -> Column:
    """Minus the sum of the log-probabilities at learnt positions (T5, labels already shifted); none raises."""
    learnt = F.filter(F.arrays_zip(log_probabilities.alias("p"), labels.alias("y")), lambda z: z["y"] != -100)
    return F.when(F.size(learnt) > 0, -total(F.transform(learnt, lambda z: z["p"]))).otherwise(F.raise_error(F.lit("no targets")).cast("double"))


def kl_to_uniform(probabilities: Column, reverse: bool = False) -> Column:
    """ln V - H(p), or minus ln V minus the mean of ln p."""
    v = F.ln(F.size(probabilities).cast("double"))
    return -v - total(F.transform(probabilities, lambda p: F.ln(p))) / F.size(probabilities) if reverse else v - entropy(probabilities)
