"""Batches and losses over arrays (survey T1-T8, H15, H18, A19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import kl_to_uniform, padded, response_labels, total, without_tokens


def response_tokens(ids: Column, prefix: list[int], limit: int, eos: int | None) -> Column:
    """A response's ids behind its ``prefix`` (such as a blank), cut so that the end mark still fits within ``limit``."""
    whole = F.concat(F.array(*[F.lit(i) for i in prefix]).cast("array<int>"), ids) if prefix else ids
    return F.slice(whole, 1, limit) if eos is None else F.array_append(F.slice(whole, 1, limit - 1), F.lit(eos))


def batch_length(longest: Column, multiple: int = 8) -> Column:
    """The length of a batch: its longest row up to the next ``multiple``."""
    return (F.ceil(longest / multiple) * multiple).cast("int")


def collated(rows: DataFrame, batch: str, prompt_limit: int, response_limit: int, eos: int, pad: int, multiple: int = 8, left_cut: bool = True, left_pad: bool = False, count_eos: bool = True) -> DataFrame:
    """(``input_ids``, ``labels``, ``attention_mask``) beside each row's own columns (T1): rows (``prompt_ids``, ``response_ids``) padded to the length of their ``batch``."""
    ids, labels = response_labels(F.col("prompt_ids"), F.col("response_ids"), prompt_limit, response_limit, eos, left_cut, count_eos)
    made = rows.withColumns({"_ids": ids, "_labels": labels})
    made = made.withColumn("_n", batch_length(F.max(F.size("_ids")).over(Window.partitionBy(batch)), multiple))
    mask = padded(F.transform("_ids", lambda _: F.lit(1)), F.col("_n"), 0, left_pad)
    return made.select(*rows.columns, padded(F.col("_ids"), F.col("_n"), pad, left_pad).alias("input_ids"), padded(F.col("_labels"), F.col("_n"), -100, left_pad).alias("labels"), mask.alias("attention_mask"))


def collated_prompts(rows: DataFrame, batch: str, limit: int, pad: int, multiple: int = 8) -> DataFrame:
    """The same for prompts alone, cut and padded at the left (T4)."""
    made = rows.withColumn("_ids", F.when(F.size("prompt_ids") > limit, F.slice("prompt_ids", -limit, limit)).otherwise(F.col("prompt_ids")))
    made = made.withColumn("_n", batch_length(F.max(F.size("_ids")).over(Window.partitionBy(batch)), multiple))
    return made.select(*rows.columns, padded(F.col("_ids"), F.col("_n"), pad, True).alias("input_ids"), padded(F.transform("_ids", lambda _: F.lit(1)), F.col("_n"), 0, True).alias("attention_mask"))


def target_log_probabilities(logits: Column, labels: Column) -> Column:
    """Log-probabilities of the labels that follow each position (T5): logits at i tell label i + 1; positions without label are left out."""
    steps = F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: (i < F.size(labels)) & (F.get(labels, i) != -100))

    def log_probability(i: Column) -> Column:
        row = F.get(logits, i - 1)
        top = F.array_max(row)
        return F.get(row, F.get(labels, i)) - top - F.ln(total(F.transform(row, lambda x: F.exp(x - top))))

    return F.transform(steps, log_probability)


def shifted_nll(logits: Column, labels: Column) -> Column:
    """A sequence's summed negative log-likelihood (T5); no target raises. Batches take its mean."""
    each = target_log_probabilities(logits, labels)
    return F.when(F.size(each) > 0, -total(each)).otherwise(F.raise_error(F.lit("no targets")).cast("double"))


def token_mean_nll(rows: DataFrame, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """``nll`` per token over all rows (T5, the other reduction)."""
    each = rows.select(target_log_probabilities(F.col(logits), F.col(labels)).alias("p"))
    return each.agg((-F.sum(F.when(F.size("p") > 0, total(F.col("p"))).otherwise(0.0)) / F.sum(F.size("p"))).alias("nll"))


def last_prompt_logits(logits: Column, mask: Column) -> Column:
    """Logits behind the last token of a prompt (T7): those of the last position that isn't masked; none raises."""
    at = F.array_max(F.transform(mask, lambda m, i: F.when(m != 0, i)))
    return F.when(at.isNull(), F.raise_error(F.lit("an empty mask")).cast("array<double>")).otherwise(F.get(logits, at))


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    mass = total(F.transform(logits, lambda x: F.exp(x - top)))
    return F.transform(logits, lambda x: F.exp(x - top) / mass)


def first_token_kl(logits: Column, mask: Column, special: list[int] = (), reverse: bool = False) -> Column:
    """Divergence of the first answer token's distribution from the uniform one over all but the ``special`` tokens."""
    return kl_to_uniform(_softmax(without_tokens(last_prompt_logits(logits, mask), list(special))), reverse)


def prefix_kl(logits: Column, labels: Column, first: int, special: list[int] = (), reverse: bool = False) -> Column:
    """Mean divergence over the ``first`` target positions of a row (T8); no target raises."""
    steps = F.slice(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (i < F.size(labels)) & (F.get(labels, i) != -100)), 1, first)
    each = F.transform(steps, lambda i: kl_to_uniform(_softmax(without_tokens(F.get(logits, i - 1), list(special))), reverse))
    return F.when(F.size(each) > 0, total(each) / F.size(each)).otherwise(F.raise_error(F.lit("no targets")).cast("double"))


def objective(nll: Column, divergence: Column, weight: float) -> Column:
    """Loss of the batch and its share of divergence (H15); anything that isn't finite raises."""
    loss = nll + F.lit(weight) * divergence
    return F.when(F.isnan(loss) | (F.abs(loss) == float("inf")), F.raise_error(F.lit("a loss that isn't finite")).cast("double")).otherwise(loss)
