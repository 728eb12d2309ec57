"""Scores: S sums weighted contributions, T multiplies it by churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.calibrate import FEATURES, Calibration, contributions


def churn_factor(churn: Column, alpha: float) -> Column:
    return 1 + F.lit(float(alpha)) * F.log1p(F.coalesce(churn, F.lit(0)).cast("double"))


def dominant(names: list[str], parts: list[Column]) -> Column:
    """The name of the largest part, the first of equals; empty if none is positive."""
    best = F.greatest(*parts, F.lit(0.0)) if parts else F.lit(0.0)
    out = F.lit("")
    for name, part in reversed(list(zip(names, parts, strict=True))):
        out = F.when((part == best) & (part > 0), F.lit(name)).otherwise(out)
    return out


def score(wide: DataFrame, cal: Calibration, weights: dict[str, float], churn: str | None = None) -> DataFrame:
    """Adds c_<feature> (scaled), s, t and dominant to a wide feature table. Narrow: no shuffle."""
    names = [n for n in (*FEATURES, *(w for w in weights if w not in FEATURES)) if n in weights and n in wide.columns]
    out = contributions(wide, cal.fits, {n: weights[n] for n in names})
    out = out.select(*wide.columns, *((F.lit(cal.k) * F.col(f"c_{n}")).alias(f"c_{n}") for n in names))
    parts = [F.col(f"c_{n}") for n in names]
    out = out.select("*", sum(parts, F.lit(0.0)).alias("s"), dominant(names, parts).alias("dominant"))
    return out.withColumn("t", F.col("s") * (churn_factor(F.col(churn), cal.alpha) if churn else F.lit(1.0)))


def contributions_map(names: list[str]) -> Column:
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"c_{n}"))))


def rank(scores: DataFrame, unit: str, top: int = 0) -> DataFrame:
    """By temperature, hottest first, ties by unit; `top` rows if positive (one heap per task, no full sort)."""
    ordered = scores.orderBy(F.col("t").desc(), F.col(unit).asc())
    return ordered.limit(top) if top > 0 else ordered


def dominant_histogram(scores: DataFrame) -> DataFrame:
    name = F.when(F.col("dominant") == "", F.lit("none")).otherwise(F.col("dominant"))
    return scores.groupBy(name.alias("dominant")).agg(F.count("*").alias("n_units"))


def churn_counts(events: DataFrame, unit: str, when: str, as_of: str, days: int, what: str) -> DataFrame:
    """unit, churn: distinct changes in the window before an explicit point in time."""
    if days <= 0:
        raise ValueError("the churn window must be positive")
    at = F.lit(as_of).cast("timestamp")
    inside = (F.col(when) >= at - F.expr(f"make_dt_interval({int(days)})")) & (F.col(when) < at)
    return events.where(inside).groupBy(unit).agg(F.count_distinct(what).alias("churn"))
