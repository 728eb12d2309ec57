"""Features that are registered beside the built-in ones.

A feature maps files (frame, path, src, n_lines, nodes: what `sources.gosrc.parsed` returns) to (frame, path, value).  It is
joined to the feature table under its name, fitted, weighted and ranked like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Measure = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Feature:
    name: str
    weight: float
    measure: Measure


REGISTRY: dict[str, Feature] = {}


def register(name: str, weight: float = 1.0) -> Callable[[Measure], Measure]:
    """Adds a feature; its weight is the default that a configuration may change. A second one of the same name is an error."""

    def add(measure: Measure) -> Measure:
        from quillspark.operators.calibrate import FEATURES

        if name in REGISTRY or name in FEATURES:
            raise ValueError(f"there is a feature {name!r} already")
        REGISTRY[name] = Feature(name, float(weight), measure)
        return measure

    return add


def extra_weights() -> dict[str, float]:
    return {f.name: f.weight for f in REGISTRY.values()}


def extended(features: DataFrame, files: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The feature table with a column for each registered feature that has a positive weight; 0 where it measures nothing."""
    for f in REGISTRY.values():
        if weights.get(f.name, 0) > 0:
            values = f.measure(files).select("frame", "path", F.col("value").cast("double").alias("_value"))
            features = features.join(values, ["frame", "path"], "left").withColumn(f.name, F.coalesce("_value", F.lit(0.0))).drop("_value")
    return features
