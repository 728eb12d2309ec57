"""Signed change between a base and a head, and the gate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.classes import label_of

MODIFIED, ADDED, REMOVED = "modified", "added", "removed"


def signed_delta(kind: Column, base: Column, head: Column) -> Column:
    """An absent side counts as zero."""
    return F.when(kind == ADDED, head).when(kind == REMOVED, -base).otherwise(head - base)


def file_deltas(base: DataFrame, head: DataFrame, unit: str) -> DataFrame:
    """unit, kind, s_base, s_head, delta from two score tables (unit, s): one full outer join on the unit."""
    b = base.select(F.col(unit), F.col("s").alias("b"))
    h = head.select(F.col(unit), F.col("s").alias("h"))
    kind = F.when(F.col("b").isNull(), ADDED).when(F.col("h").isNull(), REMOVED).otherwise(MODIFIED)
    rows = b.join(h, unit, "full").withColumn("kind", kind)
    return with_delta(rows.withColumnsRenamed({"b": "s_base", "h": "s_head"}), unit)


def with_delta(rows: DataFrame, unit: str) -> DataFrame:
    """Forces the absent side to zero and (re)computes the delta from the kind."""
    base = F.when(F.col("kind") == ADDED, 0.0).otherwise(F.coalesce("s_base", F.lit(0.0)))
    head = F.when(F.col("kind") == REMOVED, 0.0).otherwise(F.coalesce("s_head", F.lit(0.0)))
    return rows.select(unit, "kind", base.alias("s_base"), head.alias("s_head"), signed_delta(F.col("kind"), base, head).alias("delta"))


def hotspots(deltas: DataFrame, unit: str, top: int = 3) -> DataFrame:
    """The units with the highest S afterwards, highest first, ties by unit; units that are gone have none."""
    return deltas.where(F.col("s_head") > 0).orderBy(F.col("s_head").desc(), F.col(unit).asc()).limit(top)


def total(deltas: DataFrame, lines_changed: Column | int) -> DataFrame:
    """One row: total, density, lines_changed, n_files; the density's divisor is at least one."""
    lines = F.sum(lines_changed) if isinstance(lines_changed, Column) else F.lit(lines_changed)
    out = deltas.agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("total"), F.coalesce(lines, F.lit(0)).cast("long").alias("lines_changed"), F.count("*").alias("n_files"), F.coalesce(F.bool_or(_odd(F.col("delta"))), F.lit(False)).alias("odd"))
    return out.withColumn("density", F.col("total") / F.greatest(F.lit(1.0), F.col("lines_changed").cast("double")))


def _odd(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def delta_fails(density: Column, odd: Column, limit: float) -> Column:
    """Closed: anything that isn't a finite number fails; the limit itself passes."""
    return _odd(density) | odd | (density > limit)


def verdict(totals: DataFrame, pr_class: Column, limit: float, class_max: int) -> DataFrame:
    """failed and reasons (delta first, then class; the ceiling itself passes)."""
    too_much = delta_fails(F.col("density"), F.col("odd"), limit)
    too_high = pr_class > class_max
    reasons = F.array_compact(F.array(F.when(too_much, F.lit("delta_s")), F.when(too_high, F.concat(F.lit("scaling "), label_of(pr_class)))))
    return totals.select("*", (too_much | too_high).alias("failed"), reasons.alias("reasons"))


def with_bonus(totals: DataFrame, bonus: Column) -> DataFrame:
    """Totals after a bonus (zero or negative) that lowering a class has earned; adds it as `bonus`, the density follows."""
    earned = totals.withColumn("bonus", F.coalesce(bonus, F.lit(0.0))).withColumn("total", F.col("total") + F.col("bonus"))
    return earned.withColumn("density", F.col("total") / F.greatest(F.lit(1.0), F.col("lines_changed").cast("double")))


def downgrade_bonus(before: Column, after: Column, beta: float = 0.5) -> Column:
    """-beta * log2(before / after) where both sizes are positive and the size went down, else 0."""
    return F.when((before > after) & (after > 0), -F.lit(beta) * F.log2(before / after)).otherwise(F.lit(0.0))
