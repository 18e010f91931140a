"""A handle on a table at one version: inspection, row access, deletion."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import catalog, manifest, reader
from tessera.sources.manifest import Fragment, Manifest
from tessera.sources.reader import ROW_ID


class Table:
    """A version of a table; operations that commit move the handle to the new version."""

    def __init__(
        self,
        spark: SparkSession,
        uri: str | None = None,
        *,
        version: int | None = None,
        table_id: list[str] | None = None,
        namespace_impl: str | None = None,
        namespace_properties: dict[str, str] | None = None,
    ) -> None:
        self.spark = spark
        self.uri = catalog.resolve(spark, uri, namespace_impl, namespace_properties, table_id)
        self.manifest: Manifest = manifest.load(spark, self.uri, version)

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def schema(self) -> StructType:
        return self.manifest.schema

    def versions(self) -> list[dict]:
        """Number, time and operation of every version."""
        made = [manifest.load(self.spark, self.uri, v) for v in manifest.versions(self.spark, self.uri)]
        return [{"version": m.version, "timestamp": m.timestamp, "operation": m.operation} for m in made]

    def fragments(self) -> list[Fragment]:
        return list(self.manifest.fragments)

    def count_rows(self, filter: str | None = None) -> int:  # noqa: A002
        """Live rows; without a filter the manifest knows."""
        if filter is None:
            return sum(f.live_rows for f in self.manifest.fragments)
        return self.to_df(filter=filter).count()

    def __len__(self) -> int:
        return self.count_rows()

    def create_view(self, name: str) -> None:
        """Make this version's rows known to SQL under a name of the session."""
        self.to_df().createOrReplaceTempView(name)

    def estimated_bytes(self) -> int:
        """Bytes of the fragments' files as far as known."""
        return sum(f.bytes or 0 for f in self.manifest.fragments)

    def to_df(self, **options: object) -> DataFrame:
        """This version's rows; options as for `read_table`."""
        return reader.read_table(self.spark, self.uri, **{"dataset_options": {"version": self.version}} | options)

    def take(self, offsets: list[int], columns: list[str] | None = None) -> DataFrame:
        """Rows by their place among the live rows, in fragment order; reads only the fragments that hold them."""
        starts, total = [], 0
        for f in self.manifest.fragments:
            starts.append((total, f))
            total += f.live_rows
        if bad := [o for o in offsets if not 0 <= o < total]:
            raise IndexError(f"offsets {bad} are outside the table's {total} rows")
        wanted: dict[int, list[tuple[int, int]]] = {}
        for place, o in enumerate(offsets):
            start, f = next(x for x in reversed(starts) if x[0] <= o and o < x[0] + x[1].live_rows)
            wanted.setdefault(f.id, []).append((o - start, place))
        ids, live_rows = [], {f.id: f for f in self.manifest.fragments}
        for fragment, found in wanted.items():
            f = live_rows[fragment]
            gone = sorted(r[0] & 0xFFFFFFFF for r in reader.deletions(self.spark, self.uri, [f]).where(F.shiftright(ROW_ID, 32) == f.id).collect()) if f.deletions else []
            for rank, place in found:
                index = rank
                for g in gone:
                    index += g <= index
                ids.append(((fragment << 32) + index, place))
        rows = reader.live(self.spark, self.uri, self.schema, [live_rows[i] for i in wanted], row_ids=True)
        picked = rows.join(reader.bounded(self.spark.createDataFrame(ids, f"{ROW_ID} long, _place int"), len(ids)), ROW_ID).orderBy("_place")
        return picked.select(*(columns or self.schema.names))

    def delete(self, predicate: str) -> Table:
        """Mark the rows for which the predicate is true as deleted; files stay until compaction."""
        rows = reader.live(self.spark, self.uri, self.schema, list(self.manifest.fragments), row_ids=True).where(predicate).select(ROW_ID)
        path = f"_deletions/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.uri}/{path}")
        gone = self.spark.read.schema(f"{ROW_ID} long").parquet(f"{self.uri}/{path}")
        counts = {r["f"]: r["n"] for r in gone.groupBy(F.shiftright(ROW_ID, 32).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before = {f.id: f for f in self.manifest.fragments if f.id in counts}
        after = [replace(f, deletions=(*f.deletions, path), deleted_rows=f.deleted_rows + counts[f.id]) for f in before.values()]
        self.manifest = manifest.commit(self.spark, self.uri, "Delete", lambda head: manifest.replaced(head, before, [f for f in after if f.live_rows]))
        return self

    def list_indices(self) -> list[dict]:
        return [
            {"name": i.name, "type": i.type, "uuid": i.uuid, "fields": [i.column], "version": i.dataset_version, "fragment_ids": list(i.fragment_ids)}
            for i in self.manifest.indices
        ]

    def describe(self) -> str:
        """The manifest as JSON."""
        return json.dumps(json.loads(self.manifest.dumps()), indent=1)
