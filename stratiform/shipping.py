"""Makes this package importable on the executors, whatever started the session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a Spark context, as a zip of its sources."""
    sc = spark.sparkContext
    if getattr(sc, "_stratiform_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratiform-"), "stratiform.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("stratiform", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._stratiform_shipped = True
