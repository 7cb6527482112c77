"""Calibration expressions: logistic and Platt forms, tier derivation, confidence rules. Null scores stay null throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
COS_SLOPE, COS_BIAS = 60.0, -17.6
Z_SLOPE, Z_BIAS = 1.6, -4.0
KEEP_COS = 0.18
UNFITTED_EFF = 2.0
TIERS = ["alert", "violation", "review", "match", "none", "pending", "unknown"]
STD_FLOOR = 1e-6
Z_FIRE, MARGIN_FLOOR = 3.0, 0.02


def clean_score(x: Column) -> Column:
    """NaN from outside means not scored: null."""
    return F.when(~F.isnan(x), x)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1.0 / (1.0 + F.exp(-x))


def platt(score: Column, a: Column | float | None, b: Column | float | None) -> Column:
    """1 / (1 + exp(a * s + b)), the exponent clipped to 30; null if the score or the pair is null."""
    a, b = (F.lit(x).cast("double") if not isinstance(x, Column) else x for x in (a, b))
    e = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), a * score + b))
    return F.when(score.isNotNull() & a.isNotNull() & b.isNotNull(), 1.0 / (1.0 + F.exp(e)))


def platt_or_sigmoid(score: Column, a: Column, b: Column) -> Column:
    """Platt where a pair is fitted, the bare logistic where none is."""
    return F.coalesce(platt(score, a, b), F.when(score.isNotNull(), sigmoid(score)))


def squash(margin: Column, a: Column, b: Column) -> Column:
    """Zero-shot margin to probability: Platt if fitted, else a logistic of slope 20."""
    return F.coalesce(platt(margin, a, b), F.when(margin.isNotNull(), sigmoid(20.0 * margin)))


def text_p(cos: Column) -> Column:
    """Probability of a raw cosine."""
    return sigmoid(COS_SLOPE * cos + COS_BIAS)


def z_p(z: Column) -> Column:
    """Probability of a corpus z-score."""
    return sigmoid(Z_SLOPE * z + Z_BIAS)


def band(p: Column, taus: Sequence[tuple[str, float | Column | None]]) -> Column:
    """Most severe tier whose threshold p clears; tiers without threshold never fire; null p is unknown."""
    out = F.lit("none")
    for tier, tau in sorted(taus, key=lambda t: -TIERS.index(t[0])):
        if tau is not None:
            out = F.when(p >= tau, tier).otherwise(out)
    return F.when(p.isNull(), "unknown").otherwise(out)


def arbitrated(margin: Column, margin_review: Column, a: float, b: float, tau_v: float, tau_r: float, tier_margin: float) -> Column:
    """Two-margin tier: violation if its probability clears its threshold and its margin leads by tier_margin; else review if
    either probability clears the review threshold."""
    pv, pr = platt(margin, a, b), platt(margin_review, a, b)
    fires = (pv >= tau_v) & (margin >= margin_review + tier_margin)
    return F.when(margin.isNull(), "unknown").when(fires, "violation").when((pr >= tau_r) | (pv >= tau_v), "review").otherwise("none")


def tier_rank(tier: Column) -> Column:
    """Severity order, unknown names last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TIERS[:5]]), tier), F.lit(0)) - 1, F.lit(5)).cast("int")


def argmax_name(names: Sequence[str], values: Sequence[Column]) -> Column:
    """Name of the largest value; of equal ones the first."""
    top = F.greatest(*values)
    out = F.lit(None).cast("string")
    for n, v in reversed(list(zip(names, values))):
        out = F.when(v == top, n).otherwise(out)
    return out


def capped(p: Column, n: Column | int) -> Column:
    """Evidence cap: p is at most (n + 1) / (n + 2)."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.when(p.isNotNull(), F.least(p, (n + 1.0) / (n + 2.0)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k out of n; null for n = 0."""
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    return F.when(n > 0, (mid - half) / den), F.when(n > 0, (mid + half) / den)


def count_confidence(kept: Column, below: Column) -> Column:
    """Confidence of a detection count: the least kept score times one minus the best score below the threshold."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.array_min(kept), F.lit(1.0)) * (1 - F.coalesce(below, F.lit(0.0)))))


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def policy(config: dict | None, tau: float, tau_review: float) -> dict[str, float]:
    """Thresholds of a configuration, clamped: values that are not numbers within 0..1 fall back to the defaults, and a review
    threshold that is not below the violation threshold becomes half of it. Unknown keys are an error."""
    config = dict(config or {})
    if unknown := set(config) - {"tau", "tau_review"}:
        raise ValueError(f"unknown policy keys: {', '.join(sorted(unknown))}")

    def number(key: str, default: float) -> float:
        v = config.get(key, default)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and 0.0 <= v <= 1.0 else default

    t, r = number("tau", tau), number("tau_review", tau_review)
    return {"tau": t, "tau_review": r if r < t else t * 0.5}
