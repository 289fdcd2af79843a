"""Fractions and rank sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, 0 without a whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def percent(part: int, whole: int) -> str:
    return f"{(part / whole if whole else 0):.2%}"


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, without leading parts of zero."""
    minutes, rest = divmod(round(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {rest}s" if hours else f"{minutes}m {rest}s" if minutes else f"{rest}s"


def log_spaced_ranks(n: int, points: int = 300) -> list[int]:
    """Ranks 1 to n, at most ``points`` of them evenly spaced in the logarithm; the first and the last are always there."""
    if n <= points:
        return list(range(1, n + 1))
    inner = {min(max(round(math.exp(math.log(n) * i / (points - 1))), 2), n - 1) for i in range(1, points - 1)}
    return sorted({1, n} | inner)


def sampled_ranks(counts: DataFrame, n: int, points: int = 300, rank: str = "rank") -> DataFrame:
    """The rows of a rank curve at log-spaced ranks; as many as ``points`` at most, whatever n is."""
    return counts.where(F.col(rank).isin(log_spaced_ranks(n, points))) if n else counts.limit(0)
