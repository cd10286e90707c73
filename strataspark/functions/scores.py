"""Parts of the ranking score, and how rows age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataspark.schema import base_decay

#: Fixed values.
HOURLY_DECAY, VALENCE_WEIGHT, ATTRIBUTE_BOOST, DEFAULT_WEIGHT = 0.9995, 0.15, 1.5, 0.333


def hours_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3_600_000_000.0)


def time_score(created_at: Column, now: Column, alpha: float = DEFAULT_WEIGHT, decay: str = "exp") -> Column:
    """``alpha * exp(-0.9995 * hours)``; with ``decay="power"`` the documented half-life of about 58 days, ``alpha * 0.9995 ** hours``."""
    hours = hours_between(now, created_at)
    if decay == "power":
        return F.lit(alpha) * F.pow(F.lit(HOURLY_DECAY), hours)
    return F.lit(alpha) * F.exp(-F.lit(HOURLY_DECAY) * hours)


def importance_score(importance: Column, beta: float = DEFAULT_WEIGHT) -> Column:
    return F.lit(beta) * importance.cast("double") / 10.0


def valence_score(valence: Column) -> Column:
    v = valence.cast("double")
    return F.lit(VALENCE_WEIGHT) * v * F.abs(v)


def composite_score(created_at, importance, valence, similarity, now, alpha=DEFAULT_WEIGHT, beta=DEFAULT_WEIGHT, gamma=DEFAULT_WEIGHT, decay="exp") -> Column:
    """Struct of the four parts and their sum; null similarity and valence count 0."""
    parts = {
        "time": time_score(created_at, now, alpha, decay),
        "importance": importance_score(importance, beta),
        "similarity": F.lit(gamma) * F.coalesce(similarity.cast("double"), F.lit(0.0)),
        "valence": F.coalesce(valence_score(valence), F.lit(0.0)),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*(v.alias(k) for k, v in parts.items()), total.alias("total"))


def default_weights(alpha: float, beta: float, gamma: float) -> tuple[float, float, float]:
    """The defaults, but only where all three are 0."""
    return (DEFAULT_WEIGHT,) * 3 if not (alpha or beta or gamma) else (alpha, beta, gamma)


def stability_after(gets: Column) -> Column:
    """Stability of a row after so many gets."""
    return 1.0 + gets


def decay_after(layer: Column, gets: Column) -> Column:
    """Decay rate after so many gets: the layer's base over its stability; layer 1 doesn't decay."""
    return F.when(layer > 1, base_decay(layer) / (1.0 + gets)).otherwise(base_decay(layer))
