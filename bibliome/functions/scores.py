"""Small numeric rules of ranking, feedback and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The band of cosines that tells papers apart, the decay of freshness and of having been seen, the cap on venue
#: citedness, agreeing sources that count as full agreement, half-lives of evidence in days and the ceiling of its weight.
COSINE_BAND = (0.55, 0.92)
FRESHNESS_DAYS, SEEN_DAYS, CITEDNESS_CAP, AGREEMENT = 14.0, 7.0, 10.0, 3.0
HALF_LIFE = {"short": 10.0, "long": 180.0}
CEILING = 3.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def rescaled(cosine: Column) -> Column:
    low, high = COSINE_BAND
    return clamp((cosine - low) / (high - low))


def freshness(day: Column, today: Column) -> Column:
    return F.coalesce(F.exp(-F.greatest(F.datediff(today, day), F.lit(0)) / FRESHNESS_DAYS), F.lit(0.0))


def seen_fatigue(days_ago: Column) -> Column:
    return F.coalesce(clamp(1 - days_ago / SEEN_DAYS), F.lit(0.0))


def decayed(strength: Column, age_days: Column, horizon: str) -> Column:
    return strength * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / HALF_LIFE[horizon])


def saturated(total: Column) -> Column:
    return CEILING * F.tanh(total / CEILING)


def share(present: Column, followed: Column) -> Column:
    """Part of what is followed that is present; 0 where nothing is followed."""
    return F.when(F.size(followed) > 0, F.size(F.array_intersect(present, followed)) / F.size(followed)).otherwise(F.lit(0.0))


def hit(present: Column, followed: Column) -> Column:
    return F.coalesce(F.arrays_overlap(present, followed), F.lit(False)).cast("double")


def gain(grade: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1)
