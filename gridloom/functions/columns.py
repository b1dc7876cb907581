"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, places: int = 6) -> Column:
    """Rounded double without a negative zero, for stable comparison between engines."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)


def low(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def high(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


def fold_angle(a: Column) -> Column:
    """Acute version of an angle difference, scaled so that a right angle is 1."""
    m = F.abs(a) % F.lit(math.pi)
    return F.when(m > math.pi / 2, F.lit(math.pi) - m).otherwise(m) / F.lit(math.pi / 2)


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    other = F.lit(default).cast("double")
    return F.when(b != 0, a / b).otherwise(other)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def doubles(c: str | Column) -> Column:
    return F.transform(col(c), lambda v: v.cast("double"))


def with_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    A partial aggregate followed by an equi-join instead of a window: a window would send all
    rows of one group to one task, which one oversized image is enough to break.  The
    aggregate side has one row per group, so the join turns into a broadcast whenever its
    measured size allows and is split by skew handling otherwise.
    """
    if not keys:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return df.crossJoin(F.broadcast(one))  # exactly one row
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, keys)
