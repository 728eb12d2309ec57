"""Clone operators over occurrences (unit, digest, size, pos, end): intra-unit and cross-unit mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SIZE = 12


def outermost(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows not contained in an earlier kept one, for spans that are nested or disjoint.

    One window pass: ordered by start, longest first, a span is inside another if some end before it reaches
    its own.
    """
    w = Window.partitionBy(*by).orderBy(F.col("pos"), F.col("end").desc(), F.col("size").desc(), F.col("digest")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("end").over(w)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")


def intra_mass(rows: DataFrame, unit: list[str], min_size: int = MIN_SIZE) -> DataFrame:
    """unit, mass: sum of (n - 1) * size over digests kept at least twice among a unit's outermost clones."""
    times = F.count("*").over(Window.partitionBy(*unit, "digest"))
    twice = rows.where(F.col("size") >= min_size).withColumn("_n", times).where("_n >= 2").drop("_n")
    kept = outermost(twice, unit).groupBy(*unit, "digest").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n >= 2")
    return kept.groupBy(*unit).agg(F.sum((F.col("n") - 1) * F.col("size")).cast("long").alias("mass"))


def clone_classes(rows: DataFrame, unit: str, frame: list[str] | None = None, min_size: int = MIN_SIZE) -> DataFrame:
    """digest, n, n_units, original, size of each digest found at least twice. Counts are summed before the shuffle."""
    frame = frame or []
    each = rows.where(F.col("size") >= min_size).groupBy(*frame, "digest", unit).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    found = each.groupBy(*frame, "digest").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("n_units"), F.min(unit).alias("original"), F.max("size").alias("size"))
    return found.where("n >= 2")


def line_masses(rows: DataFrame, unit: str, min_size: int = MIN_SIZE) -> DataFrame:
    """unit, intra, cross: both masses of occurrences that never contain each other, such as lines.

    Occurrences are counted by unit and digest once and dealt by digest; the classes and the rows they are joined to
    read the same exchange.
    """
    # filters that either side of the join would add are stated for both, so that their exchanges are the same
    solid = rows.where((F.col("size") >= min_size) & F.col(unit).isNotNull() & F.col("digest").isNotNull())
    each = solid.groupBy(unit, "digest").agg(F.count("*").alias("n"), F.max("size").alias("size")).repartition("digest")
    classes = each.groupBy("digest").agg(F.sum("n").alias("total"), F.max("size").alias("class_size"), F.min(unit).alias("original"), F.max(unit).alias("last")).where("total >= 2")
    both = each.join(classes, "digest")
    own = F.when(F.col("n") >= 2, (F.col("n") - 1) * F.col("size")).otherwise(0)
    shared = F.when((F.col("original") != F.col("last")) & (F.col(unit) != F.col("original")), F.col("class_size")).otherwise(0)
    return both.groupBy(unit).agg(F.sum(own).cast("long").alias("intra"), F.sum(shared).cast("long").alias("cross"))


def cross_mass(rows: DataFrame, unit: str, frame: list[str] | None = None, min_size: int = MIN_SIZE) -> DataFrame:
    """unit, mass: each digest shared by two units or more is charged once to every unit but the smallest.

    The charged occurrences are reduced to the outermost first.  `frame` columns (a ref, a commit) keep
    populations apart.
    """
    frame = frame or []
    shared = clone_classes(rows, unit, frame, min_size).where("n_units >= 2").select(*frame, "digest", "original")
    charged = rows.where(F.col("size") >= min_size).join(shared, [*frame, "digest"]).where(F.col(unit) != F.col("original"))
    kept = outermost(charged, [*frame, unit]).groupBy(*frame, unit, "digest").agg(F.max("size").alias("size"))
    return kept.groupBy(*frame, unit).agg(F.sum("size").cast("long").alias("mass"))
