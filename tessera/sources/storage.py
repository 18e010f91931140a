"""Small files on any file system that Spark knows: read, list, and create exclusively."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import SparkSession


#: Storage options that end: by the uri's beginning, when to ask anew and how.
_grants: dict[str, tuple[float, Callable[[], dict[str, str]]]] = {}
#: Seconds before their end at which options are renewed, and the key that names it (milliseconds since 1970).
EARLY = 60.0
EXPIRES = "expires_at_millis"


def grant(spark: SparkSession, uri: str, options: dict[str, str] | None, renew: Callable[[], dict[str, str]]) -> None:
    """Hand a table's storage options to the session's file systems, and ask `renew` for new ones before they end."""
    given = {k: str(v) for k, v in (options or {}).items()}
    for key, value in given.items():
        if key != EXPIRES:
            spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
    if EXPIRES in given:
        _grants[uri] = (int(given[EXPIRES]) / 1000 - EARLY, renew)
    else:
        _grants.pop(uri, None)


def renewed(spark: SparkSession, uri: str) -> None:
    """Renew the options of the table that a file belongs to, if they are about to end."""
    for table, (due, renew) in list(_grants.items()):
        if uri.startswith(table) and time.time() >= due:
            grant(spark, table, renew(), renew)


def _path(spark: SparkSession, uri: str):  # noqa: ANN202
    renewed(spark, uri)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_path(uri: str) -> str | None:
    """The path of a local uri, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)


def names(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    path, fs = _path(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def make_folder(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.mkdirs(path)


def delete(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.delete(path, True)


def read_text(spark: SparkSession, uri: str) -> str:
    path, fs = _path(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, uri: str, text: str) -> bool:
    """Create the file if it doesn't exist yet; False if another writer was first.

    Local folders use a hard link, which either makes the complete file or fails. Elsewhere it is the file
    system's create without overwrite; object stores that don't check existence atomically need an
    external lock.
    """
    if (local := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    path, fs = _path(spark, uri)
    if fs.exists(path):
        return False
    stream = fs.create(path, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
