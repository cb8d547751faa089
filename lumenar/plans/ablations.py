"""Named changes of a configuration (survey G4): each sets a few values, and two that touch the same value can't be combined."""

from __future__ import annotations

import copy
from typing import Any

_FEATURES = {
    "full": ("non_special_first_token_confidence", "negative_log1p_routing_distance", "routing_margin"),
    "confidence_only": ("non_special_first_token_confidence",),
    "geometry_only": ("negative_log1p_routing_distance", "routing_margin"),
    "distance_only": ("negative_log1p_routing_distance",),
    "margin_only": ("routing_margin",),
    "confidence_margin": ("non_special_first_token_confidence", "routing_margin"),
    "confidence_distance": ("non_special_first_token_confidence", "negative_log1p_routing_distance"),
    "legacy_v1": ("non_special_first_token_confidence", "negative_log1p_routing_distance", "routing_margin"),
    "relative_margin": ("relative_routing_margin",),
    "normalized_distance": ("negative_routing_distance_z",),
    "margin_normalized_distance": ("routing_margin", "negative_routing_distance_z"),
    "router_confidence_only": ("router_confidence",),
    "router_max_probability_only": ("router_max_probability",),
    "margin_router_confidence": ("routing_margin", "router_confidence"),
    "margin_router_max_probability": ("routing_margin", "router_max_probability"),
    "full_router_geometry": ("routing_margin", "router_confidence", "router_max_probability"),
}
# What each name sets.
ABLATIONS: dict[str, dict[str, Any]] = {
    "paper": {},
    "k_ft": {"objective.method": "k_ft", "objective.lambda_kl": 0.0},
    "vanilla_ft": {"objective.method": "vanilla_ft", "objective.lambda_kl": 0.0, "clustering.num_clusters": 1},
    "first_5_tokens": {"objective.num_ood_tokens": 5},
    "uniform_to_model_kl": {"objective.kl_direction": "uniform_to_model"},
    "non_special_uniform": {"objective.uniform_scope": "non_special_tokens"},
    "uniform_cluster_ood": {"sampling.pseudo_ood_distribution": "uniform_cluster"},
    "normalized_embeddings": {"embedding.normalize": True},
    "last_token_pooling": {"embedding.pooling": "last"},
    "mean_token_pooling": {"embedding.pooling": "mean"},
    "frequency_semantic_entropy": {"evaluation.semantic_estimator": "frequency"},
    "transitive_semantic_clustering": {"evaluation.semantic_clustering_algorithm": "transitive_closure"},
    "threshold_nli": {"evaluation.nli_decision_rule": "probability_threshold"},
    "semantic_entropy_evaluation": {"evaluation.confidence_source": "semantic_entropy"},
    "first_token_only_confidence": {"evaluation.confidence_source": "first_token_entropy"},
    "provided_confidence": {"evaluation.confidence_source": "provided"},
    "sequence_probability_confidence": {"evaluation.confidence_source": "sequence_probability"},
    "random_partition": {"clustering.strategy": "random_balanced"},
    "matched_rank_80": {"lora.rank": 80, "lora.alpha": 160},
    **{f"single_pass_{name}": {"evaluation.calibration_features": list(features)} for name, features in _FEATURES.items()},
}


def applied(config: dict, names: list[str]) -> dict:
    """A copy of ``config`` (sections of values) with the named changes; unknown names and two changes of one value raise."""
    out, touched = copy.deepcopy(config), {}
    for name in names:
        if name not in ABLATIONS:
            raise ValueError(f"Unknown ablation: {name}")
        for path, value in ABLATIONS[name].items():
            if path in touched:
                raise ValueError(f"{name} and {touched[path]} both set {path}")
            touched[path] = name
            section, key = path.split(".")
            out[section][key] = copy.deepcopy(value)
    return out


def described() -> dict[str, dict[str, Any]]:
    """What each ablation sets, by name."""
    return {name: ABLATIONS[name] for name in sorted(ABLATIONS)}
