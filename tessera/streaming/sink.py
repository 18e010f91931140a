"""Streams into a table: each micro-batch is one append, and one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import manifest
from tessera.sources.writer import write_table


def append_stream(stream: DataFrame, uri: str, checkpoint: str, query_id: str = "stream", **trigger: object) -> StreamingQuery:
    """Start a query that appends to the table, made if it isn't there.

    The batch's number becomes a property of the table in the append's own commit, so a batch that is repeated
    after a failure is left out, and a batch is never there without its number.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = manifest.versions(spark, uri)
        key = f"stream.{query_id}"
        if known and manifest.load(spark, uri).properties.get(key, -1) >= number:
            return
        write_table(batch, uri, mode="append" if known else "create", properties={key: number})

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
