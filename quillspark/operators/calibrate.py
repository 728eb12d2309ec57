"""Population fit: a log-normal per feature, and the scale that puts the median unit at 1.

Feature tables are long: (unit, name, raw).  Two small actions leave the plan: at most one row per feature
(its fit) and one row (k).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.mathx import erf, normal_cdf
from quillspark.operators.ranks import median

#: Features in report order; ties of the dominant feature go to the first.
FEATURES = ("cyclomatic", "nesting", "coupling", "length", "duplication", "cross_duplication")
FLOOR = 0.3
ALPHA = 0.5


@dataclass(frozen=True)
class Fit:
    mu: float = 0.0
    sigma: float = 0.0
    valid: bool = False


@dataclass(frozen=True)
class Calibration:
    """Fits by feature name, the scale k, and the churn weight alpha."""

    fits: dict[str, Fit] = field(default_factory=dict)
    k: float = 1.0
    alpha: float = ALPHA


def fit_params(features: DataFrame) -> DataFrame:
    """name, mu, sigma, n, valid per feature over positive values: one aggregation, partial before the shuffle."""
    log = F.when(F.col("raw") > 0, F.log("raw"))
    fits = features.groupBy("name").agg(
        F.count(log).alias("n"), F.avg(log).alias("mu"), F.stddev_pop(log).alias("sigma"), F.min(log).alias("lo"), F.max(log).alias("hi")
    )
    valid = (F.col("n") >= 2) & (F.col("hi") > F.col("lo")) & (F.col("sigma") > 0)
    zero = lambda c: F.when(valid, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return fits.select("name", zero("mu"), zero("sigma"), F.col("n").cast("long").alias("n"), F.coalesce(valid, F.lit(False)).alias("valid"))


def fit(features: DataFrame) -> dict[str, Fit]:
    return {r.name: Fit(r.mu, r.sigma, r.valid) for r in fit_params(features).collect()}


def normalize(raw: Column, fit: Fit) -> Column:
    """0 to 1: how far up its population a value lies, nothing below the floor."""
    if not fit.valid:
        return F.lit(0.0)
    phi = normal_cdf((F.log(raw) - fit.mu) / fit.sigma)
    return F.when(raw > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (phi - FLOOR) / (1 - FLOOR)))).otherwise(F.lit(0.0))


def normalize_by(raw: Column, mu: Column, sigma: Column, valid: Column) -> Column:
    """`normalize` with parameters from columns, for fits that come from a join."""
    phi = normal_cdf((F.log(raw) - mu) / F.when(valid, sigma))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (phi - FLOOR) / (1 - FLOOR)))
    return F.when(valid & (raw > 0), inside).otherwise(F.lit(0.0))


def contributions(wide: DataFrame, fits: dict[str, Fit], weights: dict[str, float]) -> DataFrame:
    """Adds c_<feature>, the unscaled weighted contributions.

    Two projections: the standardised values are columns before the error function reads each of them many
    times, which keeps the expression small and inside whole-stage code.
    """
    names = [n for n in weights if n in wide.columns]
    good = [n for n in names if fits.get(n, Fit()).valid]
    raw = lambda n: F.col(n).cast("double")
    std = wide.select("*", *(F.when(raw(n) > 0, (F.log(raw(n)) - fits[n].mu) / fits[n].sigma / math.sqrt(2)).alias(f"_z_{n}") for n in good))
    norm = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.5 * (1 + erf(F.col(f"_z_{n}"))) - FLOOR) / (1 - FLOOR)))
    part = lambda n: F.when(F.col(f"_z_{n}").isNotNull(), F.lit(float(weights[n])) * F.log1p(norm(n))).otherwise(0.0) if n in good else F.lit(0.0)
    return std.select(*wide.columns, *(part(n).alias(f"c_{n}") for n in names))


def raw_scores(wide: DataFrame, fits: dict[str, Fit], weights: dict[str, float]) -> DataFrame:
    """The unscaled sum of contributions of each unit of a wide table."""
    names = [n for n in weights if n in wide.columns]
    return contributions(wide, fits, weights).select(sum((F.col(f"c_{n}") for n in names), F.lit(0.0)).alias("raw_s"))


def calibrate_k(wide: DataFrame, fits: dict[str, Fit], weights: dict[str, float]) -> float:
    """1 over the median unscaled score; 1 for no units or a median that isn't positive."""
    scores = raw_scores(wide, fits, weights).persist()  # one number a unit, read by several passes
    m = median(scores, "raw_s")
    scores.unpersist()
    return 1.0 / m if m is not None and m > 0 else 1.0


def to_long(wide: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """A wide feature table as (unit, name, raw)."""
    return wide.unpivot([unit], names, "name", "raw").withColumn("raw", F.col("raw").cast("double"))


def calibrate(wide: DataFrame, unit: str, weights: dict[str, float]) -> Calibration:
    """Fits and k of a wide feature table; cache it if it is costly to compute, it is read twice."""
    names = [n for n in weights if n in wide.columns]
    fits = fit(to_long(wide.select(unit, *(F.col(n).cast("double").alias(n) for n in names)), unit, names))
    return Calibration(fits, calibrate_k(wide, fits, weights))
