"""Exact order statistics of a column without gathering it anywhere.

A value's rank is narrowed from bin to bin: each pass counts the values of `BINS` equal parts of the range that is
left, summed before they are shuffled, and goes on in the part that holds the rank, between the smallest and the largest
value found there.  A pass brings at most `BINS` + 2 rows to the driver, whatever the size of the column, and
always leaves the ends behind, so the search ends; three or four passes are usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _values(df: DataFrame, value: str | Column) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def kth(values: DataFrame, k: int, lo: float, hi: float) -> tuple[float, int]:
    """The value with k values (column v, between lo and hi) before it in order, and the number of values up to it."""
    below = 0
    while lo < hi:
        part = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
        number = F.when(F.col("v") == lo, -1).when(F.col("v") == hi, BINS).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int"))
        bins = values.where(F.col("v").between(lo, hi)).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: r.b):
            if k < below + row.n:
                lo, hi = row.lo, row.hi
                break
            below += row.n
        if lo == hi:
            return lo, below + row.n
    return lo, below + values.where(F.col("v") == lo).count()


def median(df: DataFrame, value: str | Column) -> float | None:
    """The middle value, or the mean of the two; None for no values."""
    values = _values(df, value)
    ends = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends.n:
        return None
    low, upto = kth(values, (ends.n - 1) // 2, ends.lo, ends.hi)
    if ends.n % 2 or upto > ends.n // 2:
        return low
    return (low + values.where(F.col("v") > low).agg(F.min("v").alias("v")).first().v) / 2


def nearest_rank(df: DataFrame, value: str | Column, p: float) -> float | None:
    """The smallest value with at least the share p of all values at or below it; None for no values."""
    values = _values(df, value)
    ends = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends.n:
        return None
    rank = -int(-ends.n * p // 1)  # rounded up
    return kth(values, min(ends.n, max(1, rank)) - 1, ends.lo, ends.hi)[0]
