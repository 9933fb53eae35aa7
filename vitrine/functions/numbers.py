"""Rounding, scores, medians and cosine as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def half_up(c: Column | str) -> Column:
    """Nearest whole number; a half goes up, for negative numbers too."""
    return F.floor(col(c) + F.lit(0.5))


def rounded(c: Column | str, digits: int) -> Column:
    """Half up at a number of decimal places."""
    return half_up(col(c) * F.lit(float(10**digits))) / F.lit(float(10**digits))


def clamp100(c: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(c)))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """Whole percent, null where there is no whole; an exact half goes up, as nothing is rounded before the division."""
    return F.when(col(whole) > 0, half_up(col(part) * F.lit(100.0) / col(whole)))


def rounded_median(c: str) -> Column:
    """Median; of an even number of values, the rounded mean of the middle two."""
    middle = F.expr(f"percentile({c}, 0.5)")
    return F.when(F.count(c) % 2 == 1, middle).otherwise(half_up(middle).cast("double"))


def observed_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the rows whose value is known."""
    known = value.isNotNull()
    return F.sum(F.when(known, value * weight)) / F.sum(F.when(known, weight))


def observed_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of one row's known components; null if none is known."""
    total = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 for different lengths or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(col(a)) == F.size(col(b))) & (norms > 0), dot(a, b) / norms).otherwise(0.0)
