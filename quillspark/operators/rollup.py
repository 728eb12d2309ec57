"""Hierarchical sums, heat scales, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ranks

MIN_WEIGHT = 0.05


def prefixes(path: Column) -> Column:
    """All directories above a path, the root as ''."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def directory_weights(scores: DataFrame) -> DataFrame:
    """dir, weight, s, n_files of each directory: a leaf weighs its S, but at least `MIN_WEIGHT`."""
    rows = scores.select(F.explode(prefixes(F.col("path"))).alias("dir"), F.greatest("s", F.lit(MIN_WEIGHT)).alias("w"), "s")
    return rows.groupBy("dir").agg(F.sum("w").alias("weight"), F.sum("s").alias("s"), F.count("*").alias("n_files"))


def package_rollup(scores: DataFrame, levels: list[str], value: str = "s") -> DataFrame:
    """Sums over each level of a hierarchy and in all."""
    return scores.rollup(*levels).agg(F.sum(value).alias("s"), F.count("*").alias("n"))


def nearest_rank(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row: the smallest value with at least p of all values at or below it; 0 for no rows."""
    return df.sparkSession.range(1).select(F.lit(ranks.nearest_rank(df, value, p) or 0.0).alias("p"))


def heat_hue(t: Column, p95: Column) -> Column:
    """120 (green) to 0 (red)."""
    full = F.when(p95 > 0, t / p95).otherwise(F.lit(1.0))
    return 120 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), full)))


def bands(t: Column, note: float = 1.0, warning: float = 1.5, error: float = float("inf")) -> Column:
    """SARIF level of a temperature, null below the note floor; an option that isn't positive means its default."""
    note, warning, error = (v if v > 0 else d for v, d in ((note, 1.0), (warning, 1.5), (error, float("inf"))))
    return F.when(t < note, F.lit(None)).when(t >= error, "error").when(t >= warning, "warning").otherwise("note")


def series(scores: DataFrame, frame: list[str]) -> DataFrame:
    """Total S and number of files per frame (a commit)."""
    return scores.groupBy(*frame).agg(F.sum("s").alias("s"), F.count("*").alias("n_files"))


def time_bounds(points: DataFrame, when: str) -> DataFrame:
    """One row: first, last, n."""
    return points.agg(F.min(when).alias("first"), F.max(when).alias("last"), F.count("*").alias("n"))


def newest_then_ascending(df: DataFrame, position: str, n: int) -> DataFrame:
    """The n rows with the highest position, lowest first."""
    if n <= 0:
        raise ValueError("the limit must be positive")
    return df.orderBy(F.col(position).desc()).limit(n).orderBy(position)
