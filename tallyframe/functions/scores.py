"""Score functions: bands, screening, clipping, standardising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"phq9_total": (0.0, 27.0), "gad7_total": (0.0, 21.0)}


def band(score: Column) -> Column:
    """Severity 0 to 3 of the score rounded half to even: below 5, 10, 15."""
    r = F.bround(score)
    return F.when(r < 5, 0).when(r < 10, 1).when(r < 15, 2).when(r.isNotNull(), 3)


def screen(score: Column) -> Column:
    """1 where the unrounded score is 10 or more."""
    return (score >= 10).cast("int")


def clip(score: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (F.lit(x) if isinstance(x, float) else x for x in (low, high))
    return F.when(score.isNotNull(), F.greatest(low, F.least(high, score)))


def clip_target(score: Column, target: Column) -> Column:
    """Into the range of the target's scale; labels in any case."""
    low = F.lower(F.trim(target))
    return F.when(low == "phq9_total", clip(score, 0.0, 27.0)).when(low == "gad7_total", clip(score, 0.0, 21.0))


def finite(x: Column) -> Column:
    """NULL instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution, error below 7.5e-8."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)
