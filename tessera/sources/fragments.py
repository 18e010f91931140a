"""Writing in two phases: executors write fragments from Arrow batches, and one commit makes them visible.

    rows = df.mapInArrow(FragmentWriter(uri, transform), FRAGMENT_SCHEMA)
    commit_fragments(rows, uri)

No shuffle and no second pass, so the data may be larger than the cluster's memory; a retried task
leaves a file behind that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.sources import catalog, manifest
from tessera.sources.manifest import Fragment, Manifest
from tessera.sources.writer import MODES, as_schema, commit_fragments_at, shape

FRAGMENT_SCHEMA = "fragment string, schema string"


class FragmentWriter:
    """A function for mapInArrow: a partition's batches, transformed, go to new Parquet files.

    `transform` gets a table and returns one, or yields several. Without `schema` the first batch's is
    taken. Files are cut at `max_rows_per_file` rows or about `max_bytes_per_file` bytes in memory, however
    many batches that is.
    """

    def __init__(
        self,
        uri: str,
        transform: Callable[[pa.Table], pa.Table | Iterator[pa.Table]] | None = None,
        *,
        schema: T.StructType | pa.Schema | str | None = None,
        max_rows_per_file: int = 1024 * 1024,
        max_bytes_per_file: int | None = None,
        max_rows_per_group: int | None = None,
        data_storage_version: str | None = None,
    ) -> None:
        if max_rows_per_file <= 0:
            raise ValueError("max_rows_per_file must be positive")
        self.uri, self.transform = uri.rstrip("/"), transform
        given = as_schema(schema) if not isinstance(schema, pa.Schema) else schema
        self.schema = to_arrow_schema(given) if isinstance(given, T.StructType) else given
        self.max_rows, self.max_bytes, self.group = max_rows_per_file, max_bytes_per_file, max_rows_per_group
        self.data_storage_version = data_storage_version

    def _tables(self, table: pa.Table) -> Iterator[pa.Table]:
        made = self.transform(table) if self.transform else table
        for part in [made] if isinstance(made, pa.Table) else made:
            if not part.num_rows:
                continue
            names = self.schema.names if self.schema else part.column_names
            part = part.select([n for n in names if n in part.column_names])
            for name in names:
                if name not in part.column_names:
                    part = part.append_column(name, pa.nulls(part.num_rows, self.schema.field(name).type))
            part = part.select(names)
            yield part.cast(self.schema) if self.schema else part

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write the partition's batches; a file stays open over batches until it is full."""
        file: _File | None = None
        for batch in batches:
            for table in self._tables(pa.Table.from_batches([batch])):
                at = 0
                while at < table.num_rows:
                    file = file or _File(self.uri, table.schema, self.group)
                    part = table.slice(at, self._room(file, table))
                    file.add(part)
                    at += part.num_rows
                    if self._full(file):
                        yield file.close()
                        file = None
        if file:
            yield file.close()

    def _room(self, file: _File, table: pa.Table) -> int:
        """How many of the table's rows still go to the file, one at least."""
        rows = self.max_rows - file.rows
        if self.max_bytes:
            rows = min(rows, (self.max_bytes - file.bytes) * table.num_rows // max(1, table.nbytes))
        return max(1, rows)

    def _full(self, file: _File) -> bool:
        return file.rows >= self.max_rows or bool(self.max_bytes and file.bytes >= self.max_bytes)


class _File:
    """A Parquet file that grows by row groups; rows wait in memory for a group of their own."""

    #: Rows and bytes that wait at most.
    ROWS, BYTES = 1 << 20, 1 << 26

    def __init__(self, uri: str, schema: pa.Schema, group: int | None) -> None:
        files, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
        self.path = f"data/{uuid.uuid4().hex}/part-0.parquet"
        files.create_dir(f"{root}/{self.path.rpartition('/')[0]}", recursive=True)
        self.files, self.full, self.schema = files, f"{root}/{self.path}", schema
        self.writer = pq.ParquetWriter(self.full, schema, filesystem=files)
        self.waiting: list[pa.Table] = []
        self.group = group or self.ROWS
        self.rows = self.bytes = self.held_rows = self.held_bytes = 0

    def add(self, table: pa.Table) -> None:
        if table.schema.names != self.schema.names:
            raise ValueError(f"a batch has columns {table.schema.names}, an earlier one {self.schema.names}")
        self.waiting.append(table.cast(self.schema))
        self.rows, self.bytes = self.rows + table.num_rows, self.bytes + table.nbytes
        self.held_rows, self.held_bytes = self.held_rows + table.num_rows, self.held_bytes + table.nbytes
        if self.held_rows >= self.group or self.held_bytes >= self.BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.writer.write_table(pa.concat_tables(self.waiting), row_group_size=self.group)
            self.waiting, self.held_rows, self.held_bytes = [], 0, 0

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.writer.close()
        described = {"path": self.path, "rows": self.rows, "bytes": self.files.get_file_info(self.full).size}
        return pa.RecordBatch.from_arrays([pa.array([json.dumps(described)]), pa.array([from_arrow_schema(self.schema).json()])], ["fragment", "schema"])


def commit_fragments(
    rows: DataFrame,
    uri: str | None = None,
    *,
    mode: str = "create",
    table_id: list[str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
) -> Manifest | None:
    """Commit what FragmentWriter returned as one version; None without fragments.

    Only descriptions of files come to the driver: one short row for each fragment.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    spark = rows.sparkSession
    location = catalog.resolve_for_write(spark, mode, uri, namespace_impl, namespace_properties, table_id)
    head = manifest.load(spark, location) if mode == "append" else None
    found = [(json.loads(r["fragment"]), r["schema"]) for r in rows.select("fragment", "schema").collect()]
    schemas = {s for _, s in found}
    if len(schemas) > 1:
        raise ValueError("fragments have different schemas")
    fragments = [Fragment(-1, f["path"], f["rows"], f["bytes"]) for f, _ in found if f["rows"]]
    schema = T.StructType.fromJson(json.loads(schemas.pop())) if schemas else T.StructType()
    if head and fragments and shape(schema) != shape(head.schema):
        raise ValueError(f"the fragments have columns {shape(schema)}, the table {shape(head.schema)}")
    return commit_fragments_at(spark, location, mode, schema, fragments)
