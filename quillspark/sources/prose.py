"""Plain documents as units: lines are the clone candidates, punctuation stands in for branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.clones import line_masses

MIN_LINE = 12


def line_occurrences(docs: DataFrame, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """unit, digest, size, pos, end of each line of `MIN_LINE` characters or more, trimmed of spaces."""
    lines = docs.select(F.col(unit), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "line"))
    line = F.trim("line")
    return lines.where(F.length(line) >= MIN_LINE).select(unit, F.md5(line).alias("digest"), F.length(line).alias("size"), F.col("i").cast("long").alias("pos"), F.col("i").cast("long").alias("end"))


def features(docs: DataFrame, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """unit and the six features. Row features are one narrow pass; both clone masses come from one pass over the lines and join on the unit."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    rows = docs.select(
        F.col(unit),
        F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("cyclomatic"),
        F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))), F.lit(0)).cast("long").alias("nesting"),
        F.regexp_count(t, F.lit("[;:|]")).cast("long").alias("coupling"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("length"),
    )
    masses = line_masses(line_occurrences(docs, unit, text), unit)
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return rows.join(masses, unit, "left").select(unit, "cyclomatic", "nesting", "coupling", "length", zero("intra", "duplication"), zero("cross", "cross_duplication"))
