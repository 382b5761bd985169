"""Beta-binomial posteriors, their interval, stability and review labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.schema import ADVERSARIAL, DEFAULT_Z, HIGH_TRUST, LOW_TRUST, MIXED_TRUST, Z_VALUES


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def mean_of(values: Column, weights: dict[float, tuple[str, ...]], other: float, none: float) -> Column:
    """Mean weight of an array of words: weights by vocabulary, other for a word in none, none for an empty array."""

    def weight(x: Column) -> Column:
        out = F.lit(other)
        for w, names in weights.items():
            out = F.when(x.isin(*names), w).otherwise(out)
        return out

    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + weight(x))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(none)


def quality_multiplier(values: Column) -> Column:
    return mean_of(values, {1.0: HIGH_TRUST, 0.65: MIXED_TRUST, 0.2: LOW_TRUST}, 0.5, 0.65)


def grounding_multiplier(values: Column) -> Column:
    return mean_of(values, {1.0: ("grounded",), 0.65: ("partially_grounded",), 0.2: ("ungrounded",)}, 0.5, 0.85)


def stance_multiplier(values: Column) -> Column:
    hostile = F.size(F.filter(values, lambda x: x.isin(*ADVERSARIAL)))
    return F.when(hostile > 0, F.greatest(F.lit(0.2), 1.0 - 0.45 * hostile)).otherwise(1.0)


def z_value(credibility: float) -> float:
    return Z_VALUES.get(round(float(credibility), 2), DEFAULT_Z)


def posterior(success: Column, failure: Column, alpha: float | Column = 1.0, beta: float | Column = 1.0, credibility: float = 0.95) -> dict[str, Column]:
    """alpha, beta, mean, variance, lower, upper and effective sample size, unrounded."""
    if not 0 < credibility < 1:
        raise ValueError("credibility must be between 0 and 1")
    for x in (alpha, beta):
        if not isinstance(x, Column) and x <= 0:
            raise ValueError("priors must be positive")
    a, b = success + alpha, failure + beta
    n = a + b
    mean, variance = a / n, a * b / (n * n * (n + 1))
    half = z_value(credibility) * F.sqrt(variance)
    return {"alpha": a, "beta": b, "mean": mean, "variance": variance, "lower": clamp(mean - half), "upper": clamp(mean + half), "effective_n": success + failure}


def stability(width: Column, effective_n: Column) -> Column:
    return F.when((effective_n < 1.0) | (width >= 0.6), "fragile").when(width >= 0.35, "moderate").otherwise("stable")


#: Thresholds of the review labels.
THRESHOLDS = {"support": 0.75, "weak_support": 0.65, "contested_lower": 0.35, "contested_upper": 0.65, "minimum_n": 2.0, "wide_interval": 0.45, "prior_range": 0.2}


def classify(mean: Column, width: Column, effective_n: Column, prior_range: Column, has_support: Column, has_challenge: Column, t: dict | None = None) -> tuple[Column, Column]:
    """(label, flags): a triage label for reviewers, not a verdict."""
    t = THRESHOLDS | (t or {})
    thin, wide, swayed = effective_n < t["minimum_n"], width.isNull() | (width >= t["wide_interval"]), prior_range >= t["prior_range"]
    mixed = has_support & has_challenge
    flags = F.array_compact(F.array(F.when(thin, "thin_evidence"), F.when(wide, "wide_interval"), F.when(swayed, "prior_sensitive"), F.when(mixed, "mixed_support_challenge")))
    label = (
        F.when(mean.isNull() | thin, "thin_evidence")
        .when(swayed, "prior_sensitive")
        .when(mean.between(t["contested_lower"], t["contested_upper"]) & mixed, "contested")
        .when((mean >= t["support"]) & ~(thin | wide | swayed | mixed), "stable_support")
        .when(mean >= t["weak_support"], "fragile_support")
        .when(mixed, "contested")
        .otherwise("thin_evidence")
    )
    return label, flags
