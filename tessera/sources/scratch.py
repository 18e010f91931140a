"""A folder for tables that a query makes for itself: the one that the cluster names, or a temporary one with a local master."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_roots: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new place below this application's folder in spark.checkpoint.dir; removed when the driver's Python ends."""
    application = spark.sparkContext.applicationId
    if application not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="tables-")
        _roots[application] = f"{named.rstrip('/')}/tables-{application}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[application])
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return f"{_roots[application]}/{uuid.uuid4().hex}"


def _remove(files, path) -> None:  # noqa: ANN001
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        files.delete(path, True)
