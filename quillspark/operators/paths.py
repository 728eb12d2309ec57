"""Predicates over paths and diff records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def analyzable(path: Column, suffix: str = ".go") -> Column:
    """A source file none of whose directories is `vendor` or starts with a dot."""
    parts = F.split(path, "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: (d == "vendor") | d.startswith("."))
    return path.endswith(suffix) & ~hidden


def is_analyzable(path: str, suffix: str = ".go") -> bool:
    return path.endswith(suffix) and not any(d == "vendor" or d.startswith(".") for d in path.split("/")[:-1])


def classify_change(status: Column) -> Column:
    first = F.substring(status, 1, 1)
    return F.when(first == "A", "added").when(first == "D", "removed").when(first.isin("R", "C"), "renamed").otherwise("modified")


def classify_skip(src_mode: Column, dst_mode: Column, src_sha: Column, dst_sha: Column, is_binary: Column) -> Column:
    """The reason not to analyse a record, in order of precedence, or null."""
    either = lambda m: (src_mode == m) | (dst_mode == m)
    return (
        F.when(either("160000"), "submodule")
        .when(either("120000"), "symlink")
        .when(is_binary, "binary")
        .when((src_sha == dst_sha) & (src_mode != dst_mode), "mode_only")
    )
