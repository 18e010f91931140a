"""Compaction: adjacent small fragments become one, and deleted rows leave the files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans import compaction, placement
from tessera.plans.compaction import CompactionOptions
from tessera.sources import catalog, manifest, reader
from tessera.sources.manifest import Fragment
from tessera.sources.reader import ROW_ID
from tessera.sources.writer import file_rows


@dataclass(frozen=True)
class CompactionMetrics:
    """What a compaction changed."""

    fragments_removed: int
    fragments_added: int


def compact_files(
    spark: SparkSession,
    uri: str | None = None,
    *,
    table_id: list[str] | None = None,
    compaction_options: CompactionOptions | dict | None = None,
    num_workers: int | None = None,
    storage_options: dict[str, str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
) -> CompactionMetrics | None:
    """Rewrite planned groups in one job and commit once; None if there is nothing to do.

    Each group becomes one file: a shuffle of the small fragments only. Each has a task of its own, or they are dealt
    evenly by rows to `num_workers` tasks. A failed job commits nothing.
    """
    if num_workers is not None and num_workers <= 0:
        raise ValueError("num_workers must be positive")
    reader.set_storage(spark, storage_options)
    location = catalog.resolve(spark, uri, namespace_impl, namespace_properties, table_id)
    made = manifest.load(spark, location)
    groups = compaction.plan(made.fragments, CompactionOptions.of(compaction_options))
    if not groups:
        return None
    before = {f.id: f for g in groups for f in g}
    rows = reader.live(spark, location, made.schema, list(before.values()), row_ids=True)
    tasks = placement.balanced({k: sum(f.live_rows for f in g) for k, g in enumerate(groups)}, min(num_workers or len(groups), len(groups)))
    task_of = {k: t for t, ks in enumerate(tasks) for k in ks}
    bins = spark.createDataFrame([(f.id, k, task_of[k]) for k, g in enumerate(groups) for f in g], "_fragment long, _bin int, _task int")
    dealt = rows.withColumn("_fragment", F.shiftright(ROW_ID, 32)).join(reader.bounded(bins, len(before)), "_fragment")
    ordered = dealt.repartitionById(len(tasks), F.col("_task")).sortWithinPartitions("_bin", ROW_ID).select("_bin", *(F.col(f"`{c}`") for c in made.schema.names))
    folder = f"data/{uuid.uuid4().hex}"
    try:
        ordered.write.partitionBy("_bin").parquet(f"{location}/{folder}")
    except Exception as e:
        raise RuntimeError(f"Compaction failed: {e}") from e
    files = sorted(file_rows(spark, f"{location}/{folder}"), key=lambda x: int(x[0].split("/")[0].split("=")[1]))
    after = [Fragment(-1, f"{folder}/{name}", n, size) for name, n, size in files]
    manifest.commit(spark, location, "Rewrite", lambda head: manifest.replaced(head, before, after))
    return CompactionMetrics(len(before), len(after))
