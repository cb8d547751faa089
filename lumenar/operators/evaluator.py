"""Evaluation of generation records as they come: alias names, samples and their log-probabilities, ten estimators, measures and examples (survey P17-P22, K23, H1, A25, A7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import best_reference, best_rouge_l, entropy_confidence, rouge_1, total
from ..functions.text import semantic_text, tokens
from .evaluation import auroc, checked, scalar_metrics
from .semantic import Scorer, class_ids, class_probabilities, correct, rao_entropy, scored_class_ids, semantic_entropy

# The names under which each value may stand, the first that is present and not null counts.
PREDICTIONS = ("prediction", "generated_text", "generated_response", "generation", "greedy_generation", "greedy_response", "output", "response")
REFERENCES = ("references", "reference", "answers", "gold_answers", "targets", "target", "gold_response")
SAMPLES = ("semantic_samples", "sampled_responses", "sampled_generations", "sample_generations", "samples", "generations")
TEXTS = ("text", "prediction", "generated_text", "generated_response", "generation", "response", "output")
LOG_PROBABILITIES = ("length_normalized_log_probability", "mean_log_probability", "sequence_log_probability", "log_probability", "log_prob")
LOG_PROBABILITY_LISTS = ("length_normalized_log_probabilities", "mean_log_probabilities", "sample_log_probabilities", "sample_log_probs", "sequence_log_probabilities", "generation_log_probabilities", "log_probabilities")
TOKEN_COUNTS = ("generated_token_count", "token_count", "num_tokens")
TOKEN_LISTS = ("token_log_probabilities", "token_log_probs")
# Estimators by what they weigh, mappings by what they give.
FREQUENCY, CLASS_SUMS = ("frequency", "sample_frequency"), ("kuhn", "kuhn_eq4", "semantic_likelihood")
WEIGHTED = ("model_probability", "model_log_probability", "normalized_class_entropy", "rao", "sequence_probability")
MAPPINGS = {"exp_negative_entropy": "exp", "exp": "exp", "negative_exponential": "exp", "one_minus_normalized_entropy": "bound", "normalized_entropy": "bound", "maximum_class_probability": "max", "max_class_probability": "max", "sample_consistency": "max"}
#: Columns of a record that its example keeps.
KEPT = ("routing_distance", "second_routing_distance", "routing_margin", "first_token_entropy", "normalized_first_token_entropy", "first_token_confidence", "non_special_first_token_entropy", "normalized_non_special_first_token_entropy", "non_special_first_token_confidence")


def _fields(kind: T.DataType) -> list[str]:
    return kind.names if isinstance(kind, T.StructType) else []


def _failed(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def text_of(value: Column, kind: T.DataType) -> Column:
    """A string itself, or the first text that a struct names."""
    if isinstance(kind, T.StructType):
        named = [value[f].cast("string") for f in TEXTS if f in kind.names]
        if not named:
            raise ValueError("a struct without any text field")
        return F.coalesce(*named)
    return value.cast("string")


def _texts(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: text_of(x, kind.elementType))
    return F.when(value.isNotNull(), F.array(text_of(value, kind)))


def first_of(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in df.columns]


def prediction_of(df: DataFrame, names: tuple[str, ...] = PREDICTIONS) -> Column:
    """The prediction of a record (P18, P19); where no field has one, its first sample; none at all raises."""
    found = [text_of(F.col(n), df.schema[n].dataType) for n in first_of(df, names)]
    found += [F.get(_texts(F.col(n), df.schema[n].dataType), F.lit(0)) for n in first_of(df, SAMPLES)]
    return F.coalesce(*found, _failed("a record without prediction", "string"))


def references_of(df: DataFrame, names: tuple[str, ...] = REFERENCES) -> Column:
    """References as an array (P18): a single text is one; where no field has any, ``response`` is, if the prediction stands under another name. None or an empty list raises."""
    found = [_texts(F.col(n), df.schema[n].dataType) for n in first_of(df, names)]
    others = [F.col(n).isNotNull() for n in first_of(df, PREDICTIONS[:-1])]
    if "response" in df.columns and others:
        elsewhere = F.exists(F.array(*others), lambda x: x)
        found.append(F.when(elsewhere & F.col("response").isNotNull(), F.array(F.col("response").cast("string"))))
    given = F.coalesce(*found, _failed("a record without references", "array<string>"))
    return F.when(F.size(given) == 0, _failed("references must not be empty", "array<string>")).otherwise(given)


def sample_log_probability(sample: Column, kind: T.DataType, by_length: bool = True) -> Column:
    """The log-probability a sample brings along, per token if ``by_length`` (P20); null if it has none, a count below 1 raises."""
    names, ways = _fields(kind), []
    counts = [F.nullif(sample[n].cast("double"), F.lit(0.0)) for n in TOKEN_COUNTS if n in names]
    for n in (x for x in LOG_PROBABILITIES if x in names):
        value = sample[n].cast("double")
        if by_length and n not in LOG_PROBABILITIES[:2] and counts:
            count = F.coalesce(*counts)
            value = F.when(count.isNull(), value).when(count <= 0, _failed("token counts must be positive", "double")).otherwise(value / count)
        ways.append(value)
    for n in (x for x in TOKEN_LISTS if x in names):
        each = F.transform(sample[n], lambda x: x.cast("double"))
        empty = F.when(F.size(each) == 0, _failed("token log-probabilities must not be empty", "double"))
        ways.append(F.when(sample[n].isNotNull(), F.coalesce(empty, total(each) / F.size(each) if by_length else total(each))))
    return F.coalesce(*ways) if ways else F.lit(None).cast("double")


def samples_of(df: DataFrame, prediction: Column, by_length: bool = True) -> tuple[Column, Column]:
    """Sampled texts and their log-probabilities (P21). Without samples the prediction is the only one; a record's own list of log-probabilities comes before those in its samples and must be as long; all samples have one or none counts."""
    names = first_of(df, SAMPLES)
    texts = F.coalesce(*[_texts(F.col(n), df.schema[n].dataType) for n in names], F.array(prediction))
    texts = F.when(F.size(texts) == 0, _failed("samples must not be empty", "array<string>")).otherwise(texts)
    lists = []
    for n in first_of(df, LOG_PROBABILITY_LISTS):
        values = F.transform(F.col(n), lambda x: x.cast("double"))
        fits = F.when(F.size(values) != F.size(texts), _failed("log-probabilities must align with samples", "array<double>")).otherwise(values)
        if by_length and n not in LOG_PROBABILITY_LISTS[:2] and "sample_token_counts" in df.columns:
            counts = F.col("sample_token_counts")
            wrong = (F.size(counts) != F.size(texts)) | F.exists(counts, lambda c: c <= 0)
            fits = F.when(counts.isNull(), fits).when(wrong, _failed("sample_token_counts must be aligned and positive", "array<double>")).otherwise(F.zip_with(fits, counts, lambda v, c: v / c))
        lists.append(F.when(F.col(n).isNotNull(), fits))
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            own = F.transform(F.col(n), lambda s: sample_log_probability(s, kind.elementType, by_length))  # noqa: B023
            lists.append(F.when(F.forall(own, lambda x: x.isNotNull()), own))
    return texts, F.coalesce(*lists) if lists else F.lit(None).cast("array<double>")


def evaluated(records: DataFrame, estimator: str = "kuhn_eq4", mapping: str = "exp_negative_entropy", mode: str = "semantic", threshold: float = 0.5, by_length: bool = True, scorer: Scorer | None = None, transitive: bool = False) -> DataFrame:
    """One row per generation record (K23): ``example_id``, ``prediction``, ``references``, ``correctness``, ``semantic_entropy``, ``confidence``, ``semantic_class_ids``, ``num_semantic_classes``, ``rouge_l_f1``, ``rouge_1_f1``, ``_pos`` and what of ``KEPT`` the records have.

    Records need an order (``_pos``); ids default to it. Unknown estimators or mappings, missing predictions or references and, but for the frequency estimators, missing log-probabilities raise.
    The class-sum estimators can be negative: their confidence takes at least 0. Empty input gives no rows.
    """
    name, kind = estimator.lower().replace("-", "_"), MAPPINGS.get(mapping.lower().replace("-", "_"))
    if name not in FREQUENCY + CLASS_SUMS + WEIGHTED:
        raise ValueError(f"Unknown estimator: {estimator}")
    if kind is None:
        raise ValueError(f"Unknown mapping: {mapping}")
    prediction = prediction_of(records)
    texts, lp = samples_of(records, prediction, by_length)
    key = F.coalesce(*[F.col(c).cast("string") for c in ("example_id", "id") if c in records.columns], F.col("_pos").cast("string"))
    kept = [c for c in KEPT if c in records.columns]
    prompt = F.col("prompt") if "prompt" in records.columns else F.lit(None).cast("string")
    rows = records.select("_pos", key.alias("example_id"), prediction.alias("prediction"), references_of(records).alias("references"), texts.alias("_texts"), lp.alias("_lp"), prompt.alias("_prompt"), *kept)
    if name not in FREQUENCY:
        rows = rows.withColumn("_lp", F.coalesce("_lp", _failed("this estimator needs a log-probability for each sample", "array<double>")))
    if scorer is not None:
        rows = rows.withColumn("semantic_class_ids", scored_class_ids(scorer, transitive)("_prompt", "_texts"))
    else:  # forms are made row by row of the exploded samples, since Python cannot be called inside an array function
        each = rows.select("_pos", F.posexplode("_texts").alias("_i", "_t")).withColumn("_f", semantic_text(F.col("_t")))
        forms = each.groupBy("_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_f"))), lambda s: s["_f"]).alias("_forms"))
        rows = rows.join(forms, "_pos").withColumn("semantic_class_ids", class_ids(F.col("_forms"))).drop("_forms")
    ids, weights = F.col("semantic_class_ids"), None if name in FREQUENCY else F.col("_lp")
    h = rao_entropy(ids, weights) if name in CLASS_SUMS else semantic_entropy(ids, weights)
    classes = F.size(F.array_distinct(ids))
    rows = rows.withColumn("semantic_entropy", h).withColumn("num_semantic_classes", classes)
    sure = F.array_max(class_probabilities(ids, weights)) if kind == "max" else entropy_confidence(F.greatest(F.col("semantic_entropy"), F.lit(0.0)), classes, kind)
    said, held = tokens(F.col("prediction")), F.transform("references", lambda r: tokens(r))
    return rows.select("_pos", "example_id", "prediction", "references", correct(F.col("prediction"), F.col("references"), mode, threshold).alias("correctness"), "semantic_entropy", F.lit(name).alias("semantic_estimator"), sure.alias("confidence"), "semantic_class_ids", "num_semantic_classes", best_rouge_l(said, held).alias("rouge_l_f1"), best_reference(rouge_1, said, held).alias("rouge_1_f1"), *kept)


def evaluation_metrics(examples: DataFrame) -> DataFrame:
    """One row over ``evaluated`` (K23, A7): ``accuracy`` is the mean ROUGE-L, ``semantic_correctness_rate`` the share of right answers; ``auroc`` is null if all are alike."""
    facts = checked(examples.select("_pos", "confidence", F.col("correctness").alias("outcome")))
    means = examples.agg(F.avg("rouge_l_f1").alias("rouge_l_f1"), F.avg("rouge_1_f1").alias("rouge_1_f1"), F.avg("semantic_entropy").alias("mean_semantic_entropy"), F.avg("rouge_l_f1").alias("accuracy"))
    scalars = scalar_metrics(facts).select(F.col("examples").alias("num_examples"), "brier", F.col("accuracy").alias("semantic_correctness_rate"), "mean_confidence")
    return scalars.crossJoin(means).crossJoin(auroc(facts))


def percent_scale(metrics: DataFrame) -> DataFrame:
    """Every number of a row of measures times 100, counts of examples left out (A25); arrays stay as they are."""
    numeric = [f.name for f in metrics.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "num_examples"]
    others = [f.name for f in metrics.schema.fields if f.name not in numeric and f.name != "num_examples"]
    return metrics.select(*[(F.col(c) * 100).alias(c) for c in numeric], *others)


def calibration_summary(scored: DataFrame, bins: int = 15) -> DataFrame:
    """What a calibrator does to its rows (K26): ``examples``, ``positive_rate``, ``brier``, ``ece``, ``auroc`` of (``confidence``, ``outcome``, ``_pos``)."""
    from .evaluation import calibration_error, reliability_bins

    facts = checked(scored)
    head = scalar_metrics(facts).select("examples", F.col("accuracy").alias("positive_rate"), "brier")
    return head.crossJoin(calibration_error(reliability_bins(facts, bins))).crossJoin(auroc(facts))


def refuse_other_splits(split: str, allowed: bool = False) -> None:
    """A calibrator is fitted on validation rows unless another split is asked for by name."""
    if split != "validation" and not allowed:
        raise ValueError(f"fitting on {split} must be allowed explicitly")
