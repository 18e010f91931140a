"""Data evolution: new columns, computed for each fragment and committed as one merge.

SQL expressions stay in the JVM; an Arrow function runs over batches of at most `batch_size` rows. Only the new columns
are written, a file for each fragment with a row for each of its rows in the same order, so deleted rows
keep their places and no old column is read that the transform doesn't name, or written at all. Reads join such files
by row id; compaction with `fold_columns` makes one file of them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.sources import catalog, manifest, reader
from tessera.sources.writer import file_rows


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the planning of one job."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_PLACE = ["_fragment", "_index"]


def _appender(transform: Callable, read_columns: list[str] | None, new: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.drop_columns(_PLACE)
            got = _as_table(transform(data.select(read_columns) if read_columns else data))
            if got.num_rows != batch.num_rows:
                raise ValueError(f"the transform returned {got.num_rows} rows for {batch.num_rows}")
            if set(got.schema.names) != set(new.names):
                raise ValueError(f"the transform returned columns {got.schema.names}, not {new.names}")
            columns = [got.column(n).cast(new.field(n).type) for n in new.names]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACE), *columns], [*_PLACE, *new.names])

    return run


def _attached(df: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of `source` (with _fragment and _index, or _rowid) attached by place."""
    if reader.ROW_ID in source.columns:
        source = source.withColumns({"_fragment": F.shiftright(reader.ROW_ID, 32), "_index": F.col(reader.ROW_ID).bitwiseAND(0xFFFFFFFF)}).drop(reader.ROW_ID)
    return df.join(source, ["_fragment", "_index"], "left")


def add_columns(
    spark: SparkSession,
    uri: str | None = None,
    *,
    transform: dict[str, str] | Callable[[pa.RecordBatch], pa.RecordBatch] | DataFrame | pa.Table | pa.RecordBatchReader,
    filter: str | None = None,  # noqa: A002
    read_columns: list[str] | None = None,
    reader_schema: pa.Schema | None = None,
    read_version: int | None = None,
    storage_options: dict[str, str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
    table_id: list[str] | None = None,
    batch_size: int = 1024,
    concurrency: int | None = None,
) -> manifest.Manifest:
    """Add columns and commit.

    `transform` is a dict of new column to SQL expression, a function from an Arrow batch to a batch of the new
    columns only, a DataFrame keyed by `_rowid`, or an Arrow table or reader with one row for each of the table's
    rows in fragment order (held by the driver: for small columns). A function's column types come from
    `reader_schema`, or from a first run on one row of the table. `filter` isn't supported.
    """
    if filter is not None:
        raise NotImplementedError("filter is not supported by add_columns")
    reader.set_storage(spark, storage_options)
    location = catalog.resolve(spark, uri, namespace_impl, namespace_properties, table_id)
    made = manifest.load(spark, location, read_version)
    if not made.fragments:
        raise ValueError("No schema for new fragment found")
    if isinstance(transform, (pa.Table, pa.RecordBatchReader)):
        transform = _by_place(spark, made, transform)
    biggest = max((f.bytes or 0) for f in made.fragments)
    one_file = str(max(biggest, 128 << 20))
    before = {f.id: f for f in made.fragments}
    folder = f"data/{uuid.uuid4().hex}"
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": one_file, "spark.sql.files.openCostInBytes": one_file, "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_size)}):
        function = not isinstance(transform, (dict, DataFrame))
        read = T.StructType([made.schema[c] for c in read_columns]) if function and read_columns else T.StructType() if isinstance(transform, DataFrame) else made.schema
        rows = reader._with_row_ids(spark, location, read, list(made.fragments))
        rows = rows.withColumns({"_fragment": F.shiftright(reader.ROW_ID, 32), "_index": F.col(reader.ROW_ID).bitwiseAND(0xFFFFFFFF)}).drop(reader.ROW_ID)
        if isinstance(transform, dict):
            names = list(transform)
            _check_new(made, names)
            wide = rows.withColumns({name: F.expr(sql) for name, sql in transform.items()})
        elif isinstance(transform, DataFrame):
            names = [c for c in transform.columns if c not in (reader.ROW_ID, *_PLACE)]
            _check_new(made, names)
            wide = _attached(rows, transform)
        else:
            new = reader_schema or _tried(rows, transform, read_columns)
            names = new.names
            _check_new(made, names)
            types = T.StructType([*(rows.schema[c] for c in _PLACE), *from_arrow_schema(new).fields])
            wide = rows.mapInArrow(_appender(transform, read_columns, new), types)
        wide = wide.select(*_PLACE, *(F.col(f"`{c}`") for c in names))
        # Where whole files are read in a task each there is no shuffle; joined rows are dealt by fragment, with the new columns only.
        if isinstance(transform, DataFrame) or any(f.columns for f in made.fragments):
            wide = wide.repartition(len(made.fragments), "_fragment")
        ordered = wide.sortWithinPartitions(*_PLACE).select("_fragment", *(F.col(f"`{c}`") for c in names))
        ordered.write.partitionBy("_fragment").parquet(f"{location}/{folder}")
    found: dict[int, list[tuple[str, int, int]]] = {}
    for name, n, size in file_rows(spark, f"{location}/{folder}"):
        found.setdefault(int(name.split("/")[0].split("=")[1]), []).append((name, n, size))
    after = []
    for i, f in before.items():
        files = found.get(i, [])
        if len(files) != 1 or files[0][1] != f.rows:
            raise RuntimeError(f"fragment {i} has {f.rows} rows, its new columns {[n for _, n, _ in files]}")
        name, _, size = files[0]
        after.append(manifest.replace(f, bytes=(f.bytes or 0) + size, columns=(*f.columns, (f"{folder}/{name}", tuple(names)))))
    schema = T.StructType([*made.schema.fields, *(wide.schema[c] for c in names)])
    return manifest.commit(spark, location, "Merge", lambda head: manifest.replaced(head, before, after).with_schema(schema))


def _check_new(made: manifest.Manifest, names: list[str]) -> None:
    if clash := [n for n in names if n in made.schema.names]:
        raise ValueError(f"columns {clash} exist already")


def _tried(rows: DataFrame, transform: Callable, read_columns: list[str] | None) -> pa.Schema:
    """The new columns' schema, from a first batch of one row."""
    data = rows.select(*read_columns) if read_columns else rows.drop(*_PLACE)
    got = _as_table(transform(data.limit(1).toArrow().cast(to_arrow_schema(data.schema)).combine_chunks().to_batches()[0]))
    return got.schema


def _as_table(made: object) -> pa.Table | pa.RecordBatch:
    """What a transform returned: an Arrow batch or table, or a pandas frame."""
    return made if isinstance(made, (pa.Table, pa.RecordBatch)) else pa.Table.from_pandas(made, preserve_index=False).replace_schema_metadata(None)


def _by_place(spark: SparkSession, made: manifest.Manifest, source: pa.Table | pa.RecordBatchReader) -> DataFrame:
    """Rows held by the driver, one for each row of the table's files in fragment order, keyed by `_rowid`."""
    held = source.read_all() if isinstance(source, pa.RecordBatchReader) else source
    if held.num_rows != sum(f.rows for f in made.fragments):
        raise ValueError(f"the reader has {held.num_rows} rows for {sum(f.rows for f in made.fragments)}")
    ids = np.concatenate([(f.id << 32) + np.arange(f.rows, dtype=np.int64) for f in made.fragments])
    return spark.createDataFrame(held.append_column(reader.ROW_ID, pa.array(ids)))


