"""Make the package importable where Python tasks run."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="strayrow-"), "strayrow")
        archive = shutil.make_archive(
            target, "zip", os.path.dirname(package), os.path.basename(package)
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
