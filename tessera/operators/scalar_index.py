"""Scalar indices: B-trees for filters, inverted lists for full-text search.

A B-tree is a table (value, fragment_id), range-partitioned and sorted by value, so that a lookup reads the few row
groups that can hold its values. An inverted index is a table (token, _rowid, tf, positions), range-partitioned
and sorted by token, with a table of document lengths; the corpus sums are in the manifest.
Both are built by one job over all chosen fragments, so there are no partial indices to merge.
"""

from __future__ import annotations

import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import STOP_WORDS, tokens
from tessera.operators.index_common import check_column, check_name, commit_index, covered, open_target
from tessera.sources import reader
from tessera.sources.manifest import IndexMeta
from tessera.sources.reader import ROW_ID
from tessera.table import Table

KNOWN = ("BTREE", "BITMAP", "LABEL_LIST", "INVERTED", "FTS", "NGRAM", "ZONEMAP")
TEXT = ("INVERTED", "FTS")
BUILT = ("BTREE", *TEXT)


class IndexConfig:
    """An index type with its options (remove_stop_words, with_position); column type checks are left out for it."""

    def __init__(self, index_type: str, **parameters: object) -> None:
        self.index_type, self.parameters = index_type, parameters


def _check_type(index_type: str, column: str, kind: T.DataType) -> None:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if index_type in TEXT and not isinstance(inner, T.StringType):
        raise TypeError(f"a {index_type} index needs text: column {column} must be string type, not {kind.simpleString()}")
    if index_type == "BTREE" and not isinstance(inner, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)):
        raise TypeError(f"a BTREE index needs ordered values: column {column} must be numeric or string type, not {kind.simpleString()}")


def postings(rows: DataFrame, column: str, remove_stop_words: bool, with_position: bool, parts: int | None = None) -> DataFrame:
    """(token, _rowid, tf, positions) of rows with `_rowid`.

    With `parts` the result is range-partitioned and sorted by (token, _rowid): the tokens are dealt that way before
    they are grouped, which serves the grouping too, so there is one shuffle, and a frequent token is split by row.
    """
    words = F.transform(tokens(_text(rows, column)), lambda t, i: F.struct(t.alias("token"), i.alias("place")))
    if remove_stop_words:
        words = F.filter(words, lambda w: ~w["token"].isin(STOP_WORDS))
    flat = rows.select(ROW_ID, F.explode(words).alias("w")).select(ROW_ID, "w.token", "w.place")
    flat = flat.repartitionByRange(parts, "token", ROW_ID) if parts else flat
    places = F.sort_array(F.collect_list("place")) if with_position else F.lit(None).cast("array<int>")
    found = flat.groupBy("token", ROW_ID).agg(F.count(F.lit(1)).cast("int").alias("tf"), places.alias("positions"))
    return found.sortWithinPartitions("token", ROW_ID) if parts else found


def lengths(rows: DataFrame, column: str, remove_stop_words: bool) -> DataFrame:
    """(_rowid, length) in tokens."""
    words = tokens(_text(rows, column))
    if remove_stop_words:
        words = F.filter(words, lambda t: ~t.isin(STOP_WORDS))
    return rows.select(ROW_ID, F.coalesce(F.size(words), F.lit(0)).alias("length"))


def _text(rows: DataFrame, column: str) -> F.Column:
    c = F.col(f"`{column}`")
    return F.array_join(c, " ") if isinstance(rows.schema[column].dataType, T.ArrayType) else c


def create_scalar_index(
    spark: SparkSession,
    uri: str | Table | None = None,
    *,
    column: str,
    index_type: str | IndexConfig,
    table_id: list[str] | None = None,
    name: str | None = None,
    replace: bool = True,
    train: bool = True,
    fragment_ids: list[int] | None = None,
    index_uuid: str | None = None,
    num_workers: int = 4,
    storage_options: dict[str, str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
    remove_stop_words: bool = False,
    with_position: bool = False,
    **options: object,
) -> Table:
    """Build an index over a column and commit it; the table's handle at the new version.

    `num_workers` bounds the index's files for small tables; an index is always trained (`train`); other options are refused.
    """
    if not column:
        raise ValueError("Column name cannot be empty")
    if num_workers <= 0:
        raise ValueError(f"num_workers must be positive, got {num_workers}")
    config = isinstance(index_type, IndexConfig)
    kind_name = index_type.index_type if config else index_type
    if unknown := sorted({*options, *(index_type.parameters if config else ())} - {"remove_stop_words", "with_position"}):
        raise ValueError(f"index options {unknown} are not supported")
    if config:
        remove_stop_words = bool(index_type.parameters.get("remove_stop_words", remove_stop_words))
        with_position = bool(index_type.parameters.get("with_position", with_position))
    if kind_name not in KNOWN:
        raise ValueError(f"Index type must be one of {list(KNOWN)}, not '{kind_name}'")
    if kind_name not in BUILT:
        raise ValueError(f"Distributed indexing supports {list(BUILT)}, not '{kind_name}'")
    reader.set_storage(spark, storage_options)
    table = open_target(spark, uri, table_id, namespace_impl, namespace_properties)
    made = table.manifest
    kind = check_column(made, column)
    if not config:
        _check_type(kind_name, column, kind)
    name = name or f"{column}_idx"
    check_name(made, name, replace)
    fragments = covered(made, fragment_ids)
    key = index_uuid or str(uuids.uuid4())
    folder = f"{table.uri}/_indices/{key}"
    parts = min(num_workers, len(fragments)) if len(fragments) <= 1000 else len(fragments) // 100
    rows = reader.live(spark, table.uri, made.schema, fragments, row_ids=True).select(ROW_ID, F.col(f"`{column}`"))
    details: dict = {}
    if kind_name == "BTREE":
        value = F.col(f"`{column}`")
        pairs = rows.select((F.explode_outer(value) if isinstance(kind, T.ArrayType) else value).alias("value"), F.shiftright(ROW_ID, 32).alias("fragment_id")).distinct()
        pairs.repartitionByRange(parts, "value", "fragment_id").sortWithinPartitions("value", "fragment_id").write.parquet(folder)
    else:
        postings(rows, column, remove_stop_words, with_position, parts).write.parquet(f"{folder}/postings")
        lengths(rows, column, remove_stop_words).write.parquet(f"{folder}/lengths")
        sums = spark.read.parquet(f"{folder}/lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        details = {"documents": sums["n"], "words": sums["words"], "remove_stop_words": remove_stop_words, "with_position": with_position}
    spelled = "BTree" if kind_name == "BTREE" else "Inverted"
    index = IndexMeta(key, name, spelled, (made.field_ids[column],), column, made.version, tuple(f.id for f in fragments), 0, details)
    return commit_index(table, index, made)
