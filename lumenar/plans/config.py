"""Configuration of an experiment (survey G1-G3, V5): defaults, a file, dotted overrides, ablations, strict keys, checked values."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

from ..sources.records import fingerprint, write_json
from .ablations import applied

# Sections with their defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "model": {"name_or_path": "", "revision": None, "tokenizer_revision": None, "torch_dtype": "bfloat16", "use_cache": True},
    "data": {"name": "coqa", "dataset_id": "stanfordnlp/coqa", "dataset_config": None, "dataset_revision": None, "local_jsonl": None, "train_ratio": 0.8, "validation_ratio": 0.1, "test_ratio": 0.1, "split_seed": 2026, "split_unit": "group", "use_official_splits": False, "include_dialogue_history": False, "max_examples": None},
    "tokenization": {"max_prompt_tokens": 1536, "max_response_tokens": 256, "prompt_truncation_side": "left", "add_special_tokens_to_prompt": True, "response_prefix": " ", "append_eos": True, "include_eos_in_nll": True, "pad_to_multiple_of": 8},
    "embedding": {"layer": -1, "pooling": "last", "normalize": False, "max_length": 1536, "batch_size": 8, "dtype": "float32"},
    "clustering": {"strategy": "kmeans", "num_clusters": None, "min_clusters": 2, "max_clusters": 10, "init": "k-means++", "n_init": 10, "max_iter": 300, "tolerance": 1e-4, "random_seed": 2026, "silhouette_sample_size": 10_000, "fit_scope": "train"},
    "lora": {"rank": 16, "alpha": 32, "dropout": 0.0},
    "objective": {"method": "mixture", "lambda_kl": 0.1, "num_ood_tokens": 1, "kl_direction": "model_to_uniform", "uniform_scope": "full_vocabulary", "sequence_nll_reduction": "sequence_sum_then_batch_mean", "later_token_conditioning": "gold"},
    "sampling": {"in_batch_size": 2, "out_batch_size": 2, "pseudo_ood_distribution": "empirical_complement", "replacement": True, "dataloader_workers": 0},
    "optimization": {"optimizer": "adamw", "learning_rate": 2e-4, "scheduler": "cosine", "warmup_ratio": 0.0, "max_epochs": 10, "gradient_accumulation_steps": 8, "max_grad_norm": 1.0, "early_stopping_patience": 2},
    "generation": {"do_sample": True, "temperature": 1.0, "top_p": 1.0, "top_k": 0, "max_new_tokens": 128, "repetition_penalty": 1.0, "batch_size": 4},
    "evaluation": {"confidence_source": "single_pass", "semantic_samples": 10, "semantic_estimator": "kuhn_eq4", "semantic_confidence_mapping": "exp_negative_entropy", "entailment_threshold": 0.5, "equivalence_rule": "bidirectional_entailment", "semantic_clustering_algorithm": "representative_greedy", "nli_decision_rule": "argmax_entailment", "include_prompt_in_nli": True, "nli_batch_size": 16, "nli_max_length": 512, "nli_truncation_side": "left", "length_normalize_sequence_probability": True, "max_eval_examples": None, "calibration_features": ["non_special_first_token_confidence", "negative_log1p_routing_distance", "routing_margin"], "calibration_l2": 1e-3, "calibration_max_iter": 200, "calibration_tolerance": 1e-8, "calibrator_path": None, "ece_bins": 15, "abstain_threshold": None},
    "runtime": {"seed": 2026, "device": "cuda", "mixed_precision": "bf16", "deterministic": False, "log_every_steps": 10, "overwrite_existing": False},
}
# What a value must be one of, and the features that a calibrator may take.
CHOICES = {
    "model.torch_dtype": {"float32", "fp32", "float16", "fp16", "bfloat16", "bf16"}, "data.split_unit": {"example", "group"}, "tokenization.prompt_truncation_side": {"left", "right"}, "embedding.pooling": {"mean", "last", "first"}, "embedding.dtype": {"float32", "float16"},
    "clustering.strategy": {"kmeans", "random_balanced"}, "clustering.fit_scope": {"train", "all"}, "objective.method": {"mixture", "k_ft", "vanilla_ft"}, "objective.kl_direction": {"model_to_uniform", "uniform_to_model"}, "objective.uniform_scope": {"full_vocabulary", "non_special_tokens"},
    "objective.sequence_nll_reduction": {"sequence_sum_then_batch_mean", "token_mean"}, "sampling.pseudo_ood_distribution": {"empirical_complement", "uniform_cluster"}, "optimization.optimizer": {"adamw"}, "optimization.scheduler": {"cosine"},
    "evaluation.confidence_source": {"semantic_entropy", "first_token_entropy", "sequence_probability", "single_pass", "provided"}, "evaluation.semantic_estimator": {"kuhn_eq4", "frequency", "model_probability"}, "evaluation.semantic_confidence_mapping": {"exp_negative_entropy", "maximum_class_probability", "one_minus_normalized_entropy"},
    "evaluation.equivalence_rule": {"bidirectional_entailment"}, "evaluation.semantic_clustering_algorithm": {"representative_greedy", "transitive_closure"}, "evaluation.nli_decision_rule": {"argmax_entailment", "probability_threshold"}, "evaluation.nli_truncation_side": {"left", "right"},
    "runtime.mixed_precision": {"bf16", "bfloat16", "fp16", "float16", "fp32", "float32", "none", "no"},
}
FEATURES = {"first_token_confidence", "non_special_first_token_confidence", "normalized_first_token_entropy", "normalized_non_special_first_token_entropy", "negative_log1p_routing_distance", "routing_margin", "length_normalized_sequence_log_probability", "relative_routing_margin", "negative_routing_distance_z", "router_entropy", "router_confidence", "router_max_probability"}
#: Bounds of numbers: the least and whether it is allowed itself, the greatest and whether it is. Null is allowed where the default is null or a bound says so.
_ABOVE_ZERO, _FROM_ZERO, _UNIT = (0, False, None, False), (0, True, None, False), (0, True, 1, True)
BOUNDS = {
    **dict.fromkeys(("data.max_examples", "tokenization.max_prompt_tokens", "tokenization.max_response_tokens", "tokenization.pad_to_multiple_of", "embedding.max_length", "embedding.batch_size", "clustering.n_init", "clustering.max_iter", "lora.rank", "lora.alpha", "sampling.in_batch_size", "sampling.out_batch_size", "optimization.max_epochs", "optimization.learning_rate", "optimization.gradient_accumulation_steps", "optimization.max_grad_norm", "generation.max_new_tokens", "generation.batch_size", "evaluation.max_eval_examples", "evaluation.nli_batch_size", "evaluation.nli_max_length", "evaluation.calibration_max_iter", "evaluation.calibration_tolerance", "evaluation.ece_bins", "runtime.log_every_steps"), _ABOVE_ZERO),
    **dict.fromkeys(("data.train_ratio", "data.validation_ratio", "data.test_ratio", "objective.lambda_kl", "clustering.tolerance", "sampling.dataloader_workers", "optimization.early_stopping_patience", "generation.top_k", "evaluation.calibration_l2"), _FROM_ZERO),
    **dict.fromkeys(("evaluation.entailment_threshold", "evaluation.abstain_threshold"), _UNIT),
    "objective.num_ood_tokens": (1, True, None, False), "clustering.min_clusters": (2, True, None, False), "clustering.silhouette_sample_size": (2, True, None, False), "evaluation.semantic_samples": (2, True, None, False),
    "lora.dropout": (0, True, 1, False), "optimization.warmup_ratio": (0, True, 1, False), "generation.top_p": (0, False, 1, True),
}
NULLABLE = {"data.max_examples", "evaluation.max_eval_examples", "evaluation.abstain_threshold", "clustering.silhouette_sample_size"}


def _merged(base: dict, over: dict, where: str = "") -> dict:
    for key, value in over.items():
        if key not in base:
            raise ValueError(f"Unknown key: {where}{key}")
        base[key] = _merged(base[key], value, f"{where}{key}.") if isinstance(base[key], dict) and isinstance(value, dict) else value
    return base


def overrides(pairs: list[str]) -> dict:
    """``section.key=value`` with JSON values; anything that is no JSON is a string."""
    out: dict = {}
    for pair in pairs:
        name, found, text = pair.partition("=")
        if not found or "." not in name:
            raise ValueError(f"section.key=value is needed, not {pair}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        section, key = name.split(".", 1)
        out.setdefault(section, {})[key] = value
    return out


def _within(value: Any, bound: tuple) -> bool:
    least, least_too, most, most_too = bound
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return False
    return (value > least or least_too and value == least) and (most is None or value < most or most_too and value == most)


def problems(config: dict) -> list[str]:
    """Everything that is wrong with the values of ``config`` (G3); none for a sound one."""
    get = lambda name: config[name.split(".")[0]][name.split(".")[1]]
    out = [f"{n} must be one of {sorted(allowed)}" for n, allowed in CHOICES.items() if (get(n).lower() if n in ("model.torch_dtype", "optimization.optimizer", "optimization.scheduler") else get(n)) not in allowed]
    out += [f"{n} is out of its bounds" for n, bound in BOUNDS.items() if not (get(n) is None and n in NULLABLE) and not _within(get(n), bound)]
    if out:
        return out  # the rest compares values that are sound by themselves
    data, clustering, objective, evaluation = (config[k] for k in ("data", "clustering", "objective", "evaluation"))
    single, clusters = objective["method"] == "vanilla_ft", clustering["num_clusters"]
    rules = {
        "split ratios must add up to 1": abs(sum(data[f"{s}_ratio"] for s in ("train", "validation", "test")) - 1) <= 1e-8,
        "only the mixture takes a lambda_kl": objective["method"] == "mixture" or objective["lambda_kl"] == 0,
        "later tokens are conditioned on the gold ones only": objective["num_ood_tokens"] == 1 or objective["later_token_conditioning"] == "gold",
        "a clustered method needs two clusters or more": single or clusters is None or clusters >= 2,
        "max_clusters must be min_clusters or more": clustering["max_clusters"] >= clustering["min_clusters"],
        "a random partition needs num_clusters": clustering["strategy"] == "kmeans" or clusters is not None,
        "a random partition means nothing for a single expert": clustering["strategy"] == "kmeans" or not single,
        "sampling needs a temperature above 0": not config["generation"]["do_sample"] or config["generation"]["temperature"] > 0,
        "calibration_features must name some": bool(evaluation["calibration_features"]),
        "an unknown calibration feature": set(evaluation["calibration_features"]) <= FEATURES,
        "runtime.device must not be empty": bool(config["runtime"]["device"]),
    }
    return [message for message, holds in rules.items() if not holds]


def checked(config: dict) -> dict:
    if wrong := problems(config):
        raise ValueError("; ".join(wrong))
    return config


def _read(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML file needs the yaml package; JSON always works") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None = None, pairs: list[str] | None = None, ablations: list[str] | None = None) -> dict:
    """Defaults, then the JSON or YAML file at ``path``, then the overrides, then the ablations (G1); a fingerprint saved in the file must agree with its contents."""
    config = copy.deepcopy(DEFAULTS)
    if path:
        held = _read(path)
        saved = held.pop("fingerprint", None)
        _merged(config, held)
        if saved is not None and saved != fingerprint(config):
            raise ValueError("the saved fingerprint does not agree with the configuration")
    return checked(applied(_merged(config, overrides(pairs or [])), ablations or []))


def save_resolved(path: str, config: dict) -> None:
    """With its fingerprint, as ``load`` takes it."""
    write_json(path, {**config, "fingerprint": fingerprint(config)})


def training_fingerprint(config: dict) -> str:
    """Of what training depends on: neither generation, evaluation nor the use of a cache (V5)."""
    held = {k: v for k, v in config.items() if k not in ("generation", "evaluation")}
    return fingerprint(held | {"model": {k: v for k, v in config["model"].items() if k != "use_cache"}})
