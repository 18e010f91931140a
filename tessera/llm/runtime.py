"""Session helpers shared by the operators: shared checkpoint folder, lineage cuts, table reads."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import glob
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points counted as white space by every word rule of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder, read by Spark only (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one serves a local master; elsewhere that is an error, as executors would not see
    each other's files. The folder is removed when the driver's Python ends.
    """
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = root or tempfile.mkdtemp(prefix="checkpoints-")
        _own_folders[application] = f"{root.rstrip('/')}/cuts-{application}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folders[application])
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return _own_folders[application]


def _remove(files, path) -> None:  # noqa: ANN001
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    A lost executor then costs no recomputation, and later plans start from a scan of known size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[id(made)] = path
    weakref.finalize(made, _paths.pop, id(made), None)
    return made


_paths: dict[int, str] = {}


def drop(*tables: DataFrame) -> None:
    """Remove tables that `cut` made and nothing reads any more."""
    for table in tables:
        if path := _paths.pop(id(table), None):
            spark = table.sparkSession
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            _remove(there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there)


#: Rows of an Arrow batch at most: with long texts, Spark's default of 10,000 rows is hundreds of MB in each Python worker.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS; a smaller one stays."""
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def arrow_map(df: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """mapInArrow over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def row_wise(run: Callable, ddl: str) -> Callable:
    """A column function from an iterator over Arrow arrays; state is built once for each task.

    It counts as non-deterministic, so that a filter on its result is not pushed below it and
    does not run it twice.
    """
    small_batches(SparkSession.active())
    return F.arrow_udf(run, ddl, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def one_thread() -> None:
    """Let numpy's BLAS use one thread in this Python worker.

    A task has one core; with products of narrow matrices further threads only wait for each other. Without such a library nothing changes.
    """
    for path in glob.glob(f"{os.path.dirname(np.__file__)}.libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(ctypes.c_int(1))
                break


def unit_hash(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash of the columns, the same on every run."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


#: Ids that may be broadcast: 16 MB of longs. Beyond it the same join shuffles both sides.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Semi or anti join of wide rows with a written list of ids: broadcast only where its counted size is in bounds."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), key, how)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of `df` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def kept_only(df: DataFrame, decision: Column) -> DataFrame:
    """Rows for which an expensive decision holds, with a column of its own.

    The always-true comparison with a row number counts as non-deterministic: the optimiser then doesn't
    copy the decision's whole computation into a filter below the projections that make its columns.
    """
    name = unused(df, "kept_only")
    return df.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, decision)).where(F.col(name)).drop(name)
