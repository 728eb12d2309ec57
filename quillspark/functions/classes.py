"""Scaling classes as ranks: O(1) < O(k) < O(n) < O(n*m) < O(2^n)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels, by rank.
LABELS = ("O(1)", "O(k)", "O(n)", "O(n·m)", "O(2ⁿ)")
O1, OK, ON, ONM, O2N = range(5)
_ALIASES = {"O(n*m)": ONM, "O(2^n)": O2N}


def parse(text: str) -> int:
    """The rank of a label or of its ASCII form."""
    t = text.strip()
    if t in LABELS:
        return LABELS.index(t)
    if t in _ALIASES:
        return _ALIASES[t]
    raise ValueError(f"unknown scaling class {text!r}")


def parse_lenient(text: str) -> int:
    """`parse`, but anything unknown is the lowest class, as when reading stored results."""
    try:
        return parse(text)
    except ValueError:
        return O1


def label(rank: int) -> str:
    return LABELS[rank] if 0 <= rank < len(LABELS) else LABELS[0]


def label_of(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), rank.cast("int")), F.lit(LABELS[0]))
