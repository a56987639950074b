"""Makes the package importable in Python workers that do not share the driver's import path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    top = tempfile.mkdtemp()
    shutil.copytree(root, Path(top, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(top, root.name), "zip", Path(top, "src")))
    atexit.register(shutil.rmtree, top, ignore_errors=True)  # until then a local master reads it there
