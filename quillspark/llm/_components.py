"""Connected components without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import stage, unstage


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as stars: each node but the smallest of its component, and that smallest."""
    nodes, code = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of `links` (u, v: long) but the smallest of each component.

    Large-star and small-star steps alternate until nothing changes, however many rounds that takes; each round
    is written to the shared folder and replaces the one before. Grouped minima are summed before they move, and
    hub nodes only meet in joins that Spark can split.
    """
    order = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).alias("l")
    cur = stage(links.where(F.col("u") != F.col("v")).select(order).select("l.*").distinct(), f"{tag}-links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("t")).first()
    seen = mark(cur)
    while seen.n:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        least = least.select("x", F.least("x", "m").alias("m"))
        large = both.join(least, both.u == least.x).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.x).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stage(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), f"{tag}-links")
        now = mark(new)
        unstage(cur)
        cur = new
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
