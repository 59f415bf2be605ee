"""Ratios, weights and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d as a double, and 0 where d is not positive."""
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def click_rate(clicks: Column, impressions: Column) -> Column:
    return safe_ratio(F.sum(clicks), F.sum(impressions))


def weighted_mean(x: Column, weight: Column) -> Column:
    return safe_ratio(F.sum(x * weight), F.sum(weight))


def floored_mean(x: Column, weight: Column) -> Column:
    """Mean under weights of which those that are not positive count 1."""
    w = F.when(weight > 0, weight).otherwise(1)
    return F.sum(x * w) / F.sum(w)


def number(x: Column) -> Column:
    """Anything as a double; what is none counts 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, negative ones too."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def fairness(x: Column) -> Column:
    """Jain's index: 1 if all values are equal, 1 / n if one has everything."""
    return safe_ratio(F.pow(F.sum(x), F.lit(2.0)), F.count(x) * F.sum(x * x))


def median_seconds(x: Column) -> Column:
    return half_up(F.percentile(x, 0.5)).cast("long")


def bucket_count(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 8, "4-8").when(n <= 16, "9-16").otherwise("17+")


def normal_confidence(c: Column) -> Column:
    """Values over 1 are percentages; null stays null."""
    return F.when(c.isNotNull(), clamp(F.when(c > 1, c / 100).otherwise(c), 0, 1))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty vectors and vectors of length 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    size = lambda x: F.sqrt(total(F.transform(x, lambda y: y.cast("double") * y)))
    norm = size(a) * size(b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def unit(a: Column) -> Column:
    """A vector scaled to length 1 (null if it has none), so that a join needs only products."""
    norm = F.sqrt(F.aggregate(F.transform(a, lambda y: y.cast("double") * y), F.lit(0.0), lambda s, y: s + y))
    return F.when(norm > 0, F.transform(a, lambda y: y / norm))
