"""A logistic calibrator of confidence from one generation's features (survey K17-K19, K26, A20, H4, H5)."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid

# Features that a calibrator may use, by name.
PASSED = ("first_token_entropy", "normalized_first_token_entropy", "first_token_confidence", "non_special_first_token_entropy", "normalized_non_special_first_token_entropy", "non_special_first_token_confidence", "router_max_probability")
DERIVED = ("negative_log_routing_distance", "mean_token_log_probability", "relative_routing_margin", "router_confidence", "negative_routing_distance_z")


def feature(name: str) -> Column:
    """A feature as a column of a generation row."""
    d, second = F.col("routing_distance"), F.col("second_routing_distance")
    derived = {
        "negative_log_routing_distance": -F.log1p(F.greatest(d, F.lit(0.0))),
        "mean_token_log_probability": F.col("sequence_log_probability") / F.greatest(F.col("generated_token_count"), F.lit(1)),
        "relative_routing_margin": F.when(second <= 1e-12, 0.0).otherwise((second - d) / second),
        "router_confidence": 1 - F.col("router_entropy"),
        "negative_routing_distance_z": -F.col("routing_distance_z"),
    }
    if name in PASSED:
        return F.col(name).cast("double")
    if name not in derived:
        raise ValueError(f"Unknown feature: {name}")
    return derived[name].cast("double")


@dataclass
class Calibrator:
    features: list[str]
    means: list[float]
    scales: list[float]
    intercept: float
    weights: list[float]
    converged: bool = True
    rounds: int = 0

    def __post_init__(self) -> None:
        if not len(self.features) == len(self.means) == len(self.scales) == len(self.weights) or any(not s > 0 for s in self.scales):
            raise ValueError("features, means, scales and weights must agree, scales be positive")

    def confidence(self) -> Column:
        """A plain column expression (K19): it needs no Python worker and works on a stream."""
        terms = [w * (feature(f) - m) / s for f, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True)]
        return sigmoid(reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept))))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"version": 1} | asdict(self), sort_keys=True, indent=2))

    @classmethod
    def load(cls, path: str) -> Calibrator:
        held = json.loads(Path(path).read_text())
        if held.pop("version", None) != 1:
            raise ValueError("unknown version of a calibrator")
        return cls(**held)


def fit_calibrator(rows: DataFrame, outcome: str, features: list[str], l2: float = 1e-3, most_rounds: int = 200, tolerance: float = 1e-8) -> Calibrator:
    """Damped Newton on the mean log loss with an L2 penalty that spares the intercept.

    Each round is one aggregate of the loss, gradient and Hessian over the rows (a few numbers, combined before the shuffle); rows themselves never leave the executors. Rows with a null
    outcome or a feature that isn't finite raise. Features are standardised by population deviations, 1 where under 1e-12. One class only gives the constant of its smoothed rate.
    """
    k = len(features)
    if not k:
        raise ValueError("no features")
    named = rows.select(F.col(outcome).cast("double").alias("y"), *[feature(f).alias(f"x{i}") for i, f in enumerate(features)]).persist()
    wrong = reduce(lambda a, b: a | b, [F.col(f"x{i}").isNull() | F.isnan(f"x{i}") | (F.abs(f"x{i}") == float("inf")) for i in range(k)], F.col("y").isNull())
    first = named.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(wrong, 1)).alias("bad"), F.sum("y").alias("p"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    if not first.n or first.bad:
        named.unpersist()
        raise ValueError("rows with finite features and an outcome are needed")
    n, p = first.n, first.p
    means = [first[f"m{i}"] for i in range(k)]
    scales = [first[f"s{i}"] if first[f"s{i}"] > 1e-12 else 1.0 for i in range(k)]
    rate = (p + 0.5) / (n + 1)
    beta = np.array([math.log(rate / (1 - rate)), *[0.0] * k])
    if p in (0, n):
        named.unpersist()
        return Calibrator(features, means, scales, float(beta[0]), [0.0] * k)
    x = [F.lit(1.0), *[(F.col(f"x{i}") - means[i]) / scales[i] for i in range(k)]]
    penalty = np.array([0.0, *[l2] * k])

    def z_of(b: np.ndarray) -> Column:
        return reduce(lambda a, c: a + c, [float(w) * c for w, c in zip(b, x, strict=True)])

    def losses(points: list[np.ndarray]) -> list[float]:
        loss = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        sums = named.agg(*[F.avg(loss(z_of(b))).alias(f"l{i}") for i, b in enumerate(points)]).first()
        return [sums[f"l{i}"] + 0.5 * float((penalty * b * b).sum()) for i, b in enumerate(points)]

    converged, turn = False, 0
    for turn in range(1, most_rounds + 1):  # noqa: B007
        mu = sigmoid(z_of(beta))
        pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
        sums = named.select("y", mu.alias("mu"), *[c.alias(f"c{i}") for i, c in enumerate(x)]).agg(*[F.avg((F.col("mu") - F.col("y")) * F.col(f"c{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.avg(F.col("mu") * (1 - F.col("mu")) * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        gradient = np.array([sums[f"g{i}"] for i in range(k + 1)]) + penalty * beta
        hessian = np.diag(penalty + 1e-12)
        for i, j in pairs:
            hessian[i, j] += sums[f"h{i}_{j}"]
            if i != j:
                hessian[j, i] += sums[f"h{i}_{j}"]
        step = np.linalg.solve(hessian, gradient)
        if np.abs(gradient).max() < tolerance or np.abs(step).max() < tolerance:
            converged = True
            break
        tried = [beta, *[beta - step * 0.5**h for h in range(6)]]
        at = losses(tried)
        best = next((i for i in range(1, len(tried)) if at[i] <= at[0]), None)
        if best is None:
            converged = np.abs(gradient).max() < 1e-6
            break
        beta = tried[best]
    named.unpersist()
    return Calibrator(list(features), means, scales, float(beta[0]), [float(w) for w in beta[1:]], bool(converged), turn)
