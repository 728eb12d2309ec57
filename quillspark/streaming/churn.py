"""Churn over an event stream, with a watermark, so late events count until it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.calibrate import ALPHA
from quillspark.operators.score import churn_factor

DAY = "1 day"


def _checked(days: int) -> None:
    if days <= 0:
        raise ValueError("the churn window must be positive")


def daily_churn(events: DataFrame, unit: str, when: str, late: str = DAY) -> DataFrame:
    """window (one day), unit, churn: one row of state a unit and day, however long the windows are that are summed from it."""
    return events.withWatermark(when, late).groupBy(F.window(when, DAY), unit).agg(F.count("*").alias("churn"))


def rolling_churn(daily: DataFrame, unit: str, days: int = 90) -> DataFrame:
    """window, unit, churn, factor of all windows of so many days, one a day, summed from stored daily counts."""
    _checked(days)
    rows = daily.groupBy(F.window(F.col("window.start"), f"{days} days", DAY).alias("window"), unit).agg(F.sum("churn").alias("churn"))
    return rows.select("window", unit, "churn", churn_factor(F.col("churn"), ALPHA).alias("factor"))


def windowed_churn(events: DataFrame, unit: str, when: str, days: int = 90, slide: str = DAY, late: str = DAY) -> DataFrame:
    """window, unit, churn, factor; works on a batch and on a stream. State is bounded by the watermark.

    A batch is summed by day first, so that an event isn't repeated for each window.  A stream counts each event in all
    windows that hold it, as only that works in every output mode; for long windows keep `daily_churn` and sum it with
    `rolling_churn`.
    """
    _checked(days)
    if slide == DAY and not events.isStreaming:
        return rolling_churn(daily_churn(events, unit, when, late), unit, days)
    rows = events.withWatermark(when, late).groupBy(F.window(when, f"{days} days", slide), unit).agg(F.count("*").alias("churn"))
    return rows.select("window", unit, "churn", churn_factor(F.col("churn"), ALPHA).alias("factor"))
