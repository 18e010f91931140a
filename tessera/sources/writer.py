"""Writing: Spark writes Parquet files that no manifest names yet, and one commit makes them visible."""

from __future__ import annotations

import logging
import uuid
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.plans.compaction import small_bins
from tessera.sources import catalog, manifest, storage
from tessera.sources.manifest import ConflictError, Fragment, Manifest

log = logging.getLogger(__name__)
MODES = ("create", "append", "overwrite")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_schema(schema: T.StructType | pa.Schema | str | None) -> T.StructType | None:
    """A Spark schema from any accepted form."""
    if isinstance(schema, pa.Schema):
        return from_arrow_schema(schema)
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _strict(column: Column, source: T.DataType, target: T.DataType, name: str) -> Column:
    """A cast that fails instead of dropping a fraction."""
    if source == target:
        return column
    cast = column.cast(target)
    if isinstance(source, (T.FloatType, T.DoubleType, T.DecimalType)) and isinstance(target, _WHOLE):
        lossy = column.isNotNull() & (cast.cast(source) != column)
        return F.when(lossy, F.raise_error(F.lit(f"column {name}: a value has a fraction and doesn't fit {target.simpleString()}"))).otherwise(cast)
    return cast


def fitted(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """The rows in the schema's columns and types, by name; a missing column is null."""
    if schema is None:
        void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
        if void:
            raise ValueError(f"columns {void} have no type: give a schema")
        return df
    known = {f.name: f.dataType for f in df.schema.fields}
    if extra := [n for n in known if n not in schema.names]:
        raise ValueError(f"columns {extra} are not in the schema")
    return df.select(*(
        _strict(F.col(f"`{f.name}`"), known[f.name], f.dataType, f.name).alias(f.name, metadata=f.metadata) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ))


def file_rows(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path in the folder, rows, bytes) of the files with rows, by path: a distributed scan that reads no column."""
    found = spark.read.schema("_none int").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    inside = folder.rstrip("/").rsplit("/", 1)[1] + "/"
    return sorted((unquote(r["path"]).split(inside, 1)[1], r["n"], r["size"]) for r in found.collect())


def write_files(df: DataFrame, uri: str, min_rows: int, max_rows: int) -> list[Fragment]:
    """Write rows as fragments of at most `max_rows`, merging smaller neighbours up to `min_rows`.

    The input is computed once: rows are counted in the files, and only small files are written again.
    """
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", max_rows).parquet(f"{uri}/{folder}")
    files = file_rows(spark, f"{uri}/{folder}")
    bins = small_bins((n for _, n, _ in files), min_rows)
    if all(len(b) == 1 for b in bins):
        return [Fragment(-1, f"{folder}/{name}", n, size) for name, n, size in files]
    small = [b for b in bins if len(b) > 1]
    again = f"data/{uuid.uuid4().hex}"
    which = {files[place][0]: k for k, b in enumerate(small) for place in b}
    scan = spark.read.schema(df.schema).parquet(*(f"{uri}/{folder}/{name}" for name in which))
    placed = scan.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_index"))
    names = spark.createDataFrame(list(which.items()), "_name string, _bin int")
    dealt = placed.join(F.broadcast(names), "_name").repartitionById(len(small), F.col("_bin"))
    ordered = dealt.sortWithinPartitions("_name", "_index").select(*(F.col(f"`{c}`") for c in df.columns))
    ordered.write.option("maxRecordsPerFile", max_rows).parquet(f"{uri}/{again}")
    merged = file_rows(spark, f"{uri}/{again}")
    for name in which:
        storage.delete(spark, f"{uri}/{folder}/{name}")
    by_bin: dict[int, list[Fragment]] = {}
    for name, n, size in merged:
        by_bin.setdefault(int(name.split("-")[1]), []).append(Fragment(-1, f"{again}/{name}", n, size))
    out: list[Fragment] = []
    for b in bins:
        if len(b) == 1:
            name, n, size = files[b[0]]
            out.append(Fragment(-1, f"{folder}/{name}", n, size))
        else:
            out += by_bin.get(small.index(b), [])
    return out


def shape(schema: T.StructType) -> dict[str, str]:
    """Names and types; files are read by name, so order and nullability don't matter."""
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def commit_fragments_at(spark: SparkSession, uri: str, mode: str, schema: T.StructType, fragments: list[Fragment], properties: dict | None = None) -> Manifest | None:
    """One Overwrite or Append, with `properties` added to the table's; nothing is committed without rows.

    An append to a table whose columns are no longer those of the fragments is a conflict.
    """
    if not fragments:
        log.warning("nothing was written to %s: no rows", uri)
        return None

    def change(head: Manifest | None) -> Manifest:
        if mode == "append":
            if head is None or shape(head.schema) != shape(schema):
                raise ConflictError("the table's columns were changed by another commit")
            made = head.with_new(fragments, keep=True)
        else:
            base = head.with_schema(schema) if head else manifest.empty(schema)
            made = manifest.replace(base.with_new(fragments, keep=False), indices=())
        return manifest.replace(made, properties=made.properties | (properties or {}))

    return manifest.commit(spark, uri, "Append" if mode == "append" else "Overwrite", change)


def write_table(
    df: DataFrame,
    uri: str | None = None,
    *,
    table_id: list[str] | None = None,
    schema: T.StructType | pa.Schema | str | None = None,
    mode: str = "create",
    min_rows_per_file: int = 1024 * 1024,
    max_rows_per_file: int = 64 * 1024 * 1024,
    data_storage_version: str | None = None,
    storage_options: dict[str, str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
    concurrency: int | None = None,
    properties: dict | None = None,
) -> Manifest | None:
    """Write a DataFrame as one new version; None if it has no rows.

    `create` and `overwrite` both replace the table's rows; `append` needs an existing table and takes its
    schema. `data_storage_version` is kept as a property, as `properties` are. `concurrency` coalesces to so many tasks.
    """
    from tessera.sources.reader import set_storage

    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    for name, rows in (("min_rows_per_file", min_rows_per_file), ("max_rows_per_file", max_rows_per_file)):
        if rows is None or rows <= 0:
            raise ValueError(f"{name} must be positive")
    if min_rows_per_file > max_rows_per_file:
        raise ValueError("min_rows_per_file must not exceed max_rows_per_file")
    spark = df.sparkSession
    set_storage(spark, storage_options)
    location = catalog.resolve_for_write(spark, mode, uri, namespace_impl, namespace_properties, table_id)
    wanted = as_schema(schema)
    if mode == "append":
        head = manifest.load(spark, location)
        wanted = head.schema if wanted is None else wanted
        if [(f.name, f.dataType) for f in wanted.fields] != [(f.name, f.dataType) for f in head.schema.fields]:
            raise ValueError("the schema differs from the table's")
    rows = fitted(df, wanted)
    rows = rows.coalesce(concurrency) if concurrency else rows
    fragments = write_files(rows, location, min_rows_per_file, max_rows_per_file)
    kept = (properties or {}) | ({"data_storage_version": data_storage_version} if data_storage_version else {})
    return commit_fragments_at(spark, location, mode, rows.schema, fragments, kept)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
