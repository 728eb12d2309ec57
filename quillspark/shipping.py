"""Sends the package to the executors of a cluster that doesn't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Adds this package as a zip to all tasks of the session, now and later; returns the zip's path on the driver.

    Tasks unpickle functions by module name, so a worker that can't import `quillspark` fails at the first of them. Spark
    copies the file to each executor; nothing needs to be shared.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    return path
