"""Robust statistics on arrays and numbers, scores of deviation, circular time."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Z_THRESHOLD = 3.5


def clamp(x: Column) -> Column:
    """``x`` between 0 and 1; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def median(values: Column) -> Column:
    """Median of the non-null elements (mean of the middle two); 0 for none."""
    own = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(own)
    at = lambda i: F.get(own, i.cast("int")).cast("double")
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).otherwise(0.0)


def mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation from ``centre``."""
    return median(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.abs(v - centre)))


def robust_z(x: Column, centre: Column, spread: Column) -> Column:
    """Deviation in units of the median absolute deviation; without spread a tenth of the centre stands in."""
    stand_in = F.greatest(F.abs(centre) * 0.1, F.lit(1e-6))
    return 0.6745 * (x - centre) / F.when(spread.isNull() | (F.abs(spread) <= 1e-9), stand_in).otherwise(spread)


def score_of_z(z: Column, threshold: float = Z_THRESHOLD) -> Column:
    return F.when(z.isNotNull(), F.least(F.abs(z) / threshold, F.lit(1.0)))


def novelty(seen: Column, total: Column) -> Column:
    """1 for a value never seen, falling with its share of what was seen."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 1.0).when(F.coalesce(seen, F.lit(0)) <= 0, 1.0).otherwise(F.greatest(1 - seen / total, F.lit(0.0)))


def circular_hour(sum_sin: Column, sum_cos: Column) -> Column:
    """Mean hour from summed sines and cosines of hour angles; null where it is undefined."""
    angle = F.atan2(sum_sin, sum_cos) * 12 / math.pi
    return F.when((F.abs(sum_sin) < 1e-12) & (F.abs(sum_cos) < 1e-12), None).otherwise(F.pmod(angle, F.lit(24.0)))


def hour_anomaly(hour: Column, typical: Column) -> Column:
    gap = F.pmod(F.abs(hour - typical), F.lit(24.0))
    return F.when(gap.isNull(), 0.0).otherwise(F.least(F.least(gap, 24.0 - gap) / 12.0, F.lit(1.0)))


def weekday_anomaly(day: Column, typical: Column) -> Column:
    gap = F.pmod(F.abs(day - typical), F.lit(7))
    return F.when(gap.isNull(), 0.0).otherwise(F.least(F.least(gap, 7 - gap) / 3.0, F.lit(1.0)))
