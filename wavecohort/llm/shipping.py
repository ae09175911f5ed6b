"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to all executors, once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="sources-")  # read by the driver's file server only
        name = os.path.join(folder, "wavecohort_sources")
        root = os.path.dirname(package)
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, os.path.basename(package)))
        _shipped.add(app)
    return spark
