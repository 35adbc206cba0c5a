"""Decay, utility, salience and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the memory model.
BOOST_HALF_LIFE_DAYS = 7.0
ACCESS_SATURATION = 10.0
ENTITY_HALF_LIFE_DAYS = 30.0
MIN_DECAY_RATE = 0.001
MAX_DECAY_RATE = 0.05
SATURATION_PER_DAY = 5
WORN = 1.02
UNIT_BOOST = (0.25, 4.0)
PRUNE_BELOW = 0.1


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def half_life(days: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(half))


def access_frequency(ages: Column, half: float = BOOST_HALF_LIFE_DAYS, saturation: float = ACCESS_SATURATION) -> Column:
    """Aggregate: recency-weighted number of accesses (one row each, ages in days), as a share of saturation up to 1."""
    return F.least(F.lit(1.0), F.coalesce(F.sum(half_life(ages, half)), F.lit(0.0)) / F.lit(saturation))


def utility(access: Column, structural: Column) -> Column:
    return F.lit(0.4) * access + F.lit(0.6) * structural


def dream_rate(rate: Column, base: Column, days: Column, half: float = BOOST_HALF_LIFE_DAYS, least: float = MIN_DECAY_RATE) -> Column:
    """A decay rate that has drifted back towards its base."""
    return F.greatest(F.lit(least), base + (rate - base) * half_life(days, half))


def dream_score(score: Column, rate: Column, days: Column) -> Column:
    return score * F.pow(F.lit(1.0) - rate, days)


def eased(earlier: Column, modifier: Column) -> Column:
    """What a retrieval multiplies a decay rate by: less of a cut the more retrievals there were."""
    return F.lit(1.0) - F.lit(0.05) * modifier / (F.lit(1.0) + F.lit(0.3) * earlier)


def retrieval_rate(rate: Column, earlier: Column, recent: Column, modifier: Column) -> Column:
    """Decay rate after a retrieval, given earlier retrievals and those of the last day.

    Over the daily limit the rate rises by 2 % up to its ceiling; otherwise it falls by
    a boost that diminishes with the number of retrievals.
    """
    worn = F.least(F.lit(MAX_DECAY_RATE), rate * F.lit(WORN))
    return F.greatest(F.lit(MIN_DECAY_RATE), F.when(recent > SATURATION_PER_DAY, worn).otherwise(rate * eased(earlier, modifier)))


def entity_salience(mentions: Column, structural: Column, age_days: Column) -> Column:
    """min(1, 0.1 + 0.03 sqrt(n)), times structural salience where known, times recency; 0 without mentions."""
    base = F.least(F.lit(1.0), F.lit(0.1) + F.lit(0.03) * F.sqrt(mentions.cast("double")))
    bounded = F.when(structural.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), structural)))
    value = base * F.coalesce(bounded, F.lit(1.0)) * F.coalesce(half_life(age_days, ENTITY_HALF_LIFE_DAYS), F.lit(1.0))
    return F.when(F.coalesce(mentions, F.lit(0)) > 0, value).otherwise(F.lit(0.0))


def boosted(old: Column, rating: Column) -> Column:
    """A unit's boost after a rating from 1 to 5, within its bounds."""
    return F.least(F.lit(UNIT_BOOST[1]), F.greatest(F.lit(UNIT_BOOST[0]), old * (F.lit(0.5) + (rating - 1) / F.lit(4.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 1) without trials."""
    zz = F.lit(z * z)
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return low, high
