"""Order statistics and thresholds over arrays, as Catalyst higher-order expressions.

Every function takes an array column of numbers without nulls and gives a defined value for the empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(sorted_: Column, i: Column) -> Column:
    return F.get(sorted_, i.cast("int"))


def nearest_rank(values: Column, p: float) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n == 0, F.lit(0.0)).otherwise(at(s, F.least(n - 1, F.floor(n * p))))


def median(values: Column) -> Column:
    """True median: the mean of the middle two for an even count; 0 when empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n == 0, F.lit(0.0)).otherwise((at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2)


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(at(s, F.floor(F.size(s) / 2)))


def iqr_bounds(values: Column) -> tuple[Column, Column]:
    """Bounds outside of which a value is a peak: quartiles without interpolation, a spread of 1.5 ranges, 5 at least."""
    s = F.array_sort(values)
    n = F.size(s)
    q1, q3 = at(s, F.floor(n * 0.25)), at(s, F.floor(n * 0.75))
    t = F.greatest((q3 - q1) * 1.5, F.lit(5.0))
    return q1 - t, q3 + t


def iqr_peaks(values: Column) -> Column:
    """Indexes of peaks; none among fewer than three values."""
    lo, hi = iqr_bounds(values)
    idx = F.filter(F.transform(values, lambda v, i: F.when((v < lo) | (v > hi), i)), lambda i: i.isNotNull())
    return F.when(F.size(values) < 3, F.array().cast("array<int>")).otherwise(idx)


def otsu(values: Column) -> Column:
    """Threshold of greatest between-class variance over integers from 0; the first best; 0 when empty or all zero."""
    n, total, top = F.size(values), F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.array_max(values)

    def gain(t: Column) -> Column:
        low = F.filter(values, lambda v: v <= t)
        k, s = F.size(low), F.aggregate(low, F.lit(0.0), lambda a, v: a + v)
        d = s / k - (total - s) / (n - k)
        return F.when((k > 0) & (k < n), k.cast("double") * (n - k) * d * d).otherwise(F.lit(0.0))

    # only occurring values change the classes, so they are the only thresholds to try
    tries = F.transform(F.array_sort(F.array_distinct(values)), lambda t: F.struct(gain(t).alias("g"), (-t).alias("t")))
    best = F.array_max(tries)
    return F.when((n == 0) | F.coalesce(top <= 0, F.lit(True)), F.lit(0)).otherwise(F.when(best["g"] > 0, -best["t"]).otherwise(F.lit(0)))


def adaptive_min_area(heights: Column) -> Column:
    """Square of a quarter of the interquartile mean of heights, at least 4."""
    s = F.array_sort(heights)
    n = F.size(s)
    a, b = F.floor(n / 4).cast("int"), F.floor(n * 3 / 4).cast("int")
    mid = F.slice(s, a + 1, F.greatest(b - a, F.lit(0)))
    mean = F.aggregate(mid, F.lit(0.0), lambda x, v: x + v) / F.size(mid)
    return F.when(F.size(mid) == 0, F.lit(4)).otherwise(F.greatest(F.lit(4), F.floor(F.pow(mean * 0.25, F.lit(2))).cast("int")))
