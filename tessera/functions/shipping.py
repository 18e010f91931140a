"""Sending this library to the executors of a session that was started without it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="shipped-")  # executors fetch the file from the driver when their first task starts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
