"""Reading: a version's live fragments as one native Parquet scan.

Projection and filter stay ordinary DataFrame operations, so Catalyst prunes columns and pushes the
filter into the scan. Columns that were added later lie in files of their own: where a read names its columns, only
the files that hold them are read, and rows of several files are joined by their row id. Fragments with deleted rows are read apart from the others, and only they take
part in the anti join with the deletion files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import catalog, manifest
from tessera.sources.manifest import Fragment, Manifest

ROW_ID = "_rowid"
#: Rows of (long, long) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
SCAN_OPTIONS = {"columns", "filter", "with_row_id", "batch_size", "nearest", "full_text_query"}


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side of known size within the bound, a shuffle join otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _scan(spark: SparkSession, uri: str, schema: StructType, fragments: list[Fragment]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{uri}/{f.path}" for f in fragments))


def _short(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def _files_with_row_ids(spark: SparkSession, uri: str, schema: StructType, files: list[tuple[int, str]]) -> DataFrame:
    """Columns of some (fragment id, path) with (fragment id << 32) | row index as `_rowid`; a file is known by its last two path parts."""
    scan = spark.read.schema(schema).parquet(*(f"{uri}/{path}" for _, path in files)).select("*", F.url_decode(_short(F.col("_metadata.file_path"))).alias("_file"), F.col("_metadata.row_index").alias("_index"))
    if len(files) == 1:
        ids = scan.withColumn("_fragment", F.lit(files[0][0]).cast("long"))
    else:
        known = spark.createDataFrame([("/".join(path.split("/")[-2:]), i) for i, path in files], "_file string, _fragment long")
        ids = scan.join(bounded(known, len(files)), "_file")
    return ids.select(*(F.col(f"`{f.name}`") for f in schema.fields), (F.shiftleft("_fragment", 32) + F.col("_index")).alias(ROW_ID))


def _with_row_ids(spark: SparkSession, uri: str, schema: StructType, fragments: list[Fragment]) -> DataFrame:
    """The scan with `_rowid`. Column files that hold none of the schema's columns aren't read, others are joined by `_rowid`."""
    kinds: dict[tuple, list[Fragment]] = {}
    for f in fragments:
        kinds.setdefault(tuple(names for _, names in f.columns), []).append(f)
    frames = []
    for layout, alike in kinds.items():
        added = [set(names) for names in layout]
        own = [f for f in schema.fields if not any(f.name in names for names in added)]
        parts = [([f for f in schema.fields if f.name in names], k) for k, names in enumerate(added)]
        parts = [(fields, k) for fields, k in parts if fields]
        scans = [_files_with_row_ids(spark, uri, StructType(fields), [(f.id, f.columns[k][0]) for f in alike]) for fields, k in parts]
        if own or not scans:
            scans.insert(0, _files_with_row_ids(spark, uri, StructType(own), [(f.id, f.path) for f in alike]))
        whole = reduce(lambda one, other: one.join(other, ROW_ID), scans)
        frames.append(whole.select(*(F.col(f"`{f.name}`") for f in schema.fields), ROW_ID))
    return reduce(DataFrame.union, frames)


def deletions(spark: SparkSession, uri: str, fragments: list[Fragment]) -> DataFrame:
    """Row ids deleted from the fragments."""
    files = sorted({f"{uri}/{d}" for f in fragments for d in f.deletions})
    return spark.read.schema(f"{ROW_ID} long").parquet(*files)


def live(spark: SparkSession, uri: str, schema: StructType, fragments: list[Fragment], row_ids: bool = False) -> DataFrame:
    """Live rows of the fragments, in no order; with `_rowid` if asked for."""
    if not fragments:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(ROW_ID, F.lit(None).cast("long")) if row_ids else empty
    names = [F.col(f"`{f.name}`") for f in schema.fields]
    whole, cut = [f for f in fragments if not f.deletions], [f for f in fragments if f.deletions]
    if not row_ids:
        plain, whole = [f for f in whole if not f.columns], [f for f in whole if f.columns]
    else:
        plain = []
    parts = [_scan(spark, uri, schema, plain)] if plain else []
    if whole:
        rows = _with_row_ids(spark, uri, schema, whole)
        parts.append(rows if row_ids else rows.select(*names))
    if cut:
        gone = deletions(spark, uri, cut)
        kept = _with_row_ids(spark, uri, schema, cut).join(bounded(gone, sum(f.deleted_rows for f in cut)), ROW_ID, "left_anti")
        parts.append(kept.select(*names, *([ROW_ID] if row_ids else [])))
    return reduce(DataFrame.union, parts)


def chosen(made: Manifest, fragment_ids: list[int] | None) -> list[Fragment]:
    """The named fragments; none or an empty list means all, unknown ids drop out."""
    wanted = set(fragment_ids or ())
    return [f for f in made.fragments if not wanted or f.id in wanted]


def read_table(
    spark: SparkSession,
    uri: str | None = None,
    *,
    table_id: list[str] | None = None,
    columns: list[str] | None = None,
    filter: str | None = None,  # noqa: A002
    storage_options: dict[str, str] | None = None,
    scanner_options: dict | None = None,
    dataset_options: dict | None = None,
    fragment_ids: list[int] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
    concurrency: int | None = None,
    override_num_blocks: int | None = None,
) -> DataFrame:
    """A table's rows as a DataFrame, lazily.

    `columns` and `filter` override their namesakes in `scanner_options`, which also takes with_row_id,
    and batch_size: the rows of an Arrow batch at most that Python functions of this session then get. Other
    options are refused. `dataset_options["version"]` reads an
    older version. `scanner_options["full_text_query"]` (a string, or a dict with query and columns) and
    `scanner_options["nearest"]` (a dict with column, q, k and the options of `nearest`) search instead. An index on a filtered column is used to leave fragments out. Storage credentials
    belong to the session's Hadoop settings; `storage_options` are set there. `override_num_blocks` makes so many
    partitions, by a shuffle only if the scan has fewer; `concurrency` is the most tasks that read at once.
    """
    from tessera.plans.prune import fragments_for

    location = catalog.resolve(spark, uri, namespace_impl, namespace_properties, table_id)
    set_storage(spark, storage_options)
    options = dict(scanner_options or {})
    if unknown := sorted(set(options) - SCAN_OPTIONS):
        raise ValueError(f"scan options {unknown} are not supported; known: {sorted(SCAN_OPTIONS)}")
    for name, value in (("concurrency", concurrency), ("override_num_blocks", override_num_blocks), ("batch_size", options.get("batch_size"))):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    if options.get("batch_size"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(options["batch_size"]))
    columns = options.get("columns") if columns is None else columns
    predicate = options.get("filter") if filter is None else filter
    made = manifest.load(spark, location, (dataset_options or {}).get("version"))
    if options.get("nearest") or options.get("full_text_query"):
        return _searched(spark, location, made.version, columns, predicate, options)
    fragments = chosen(made, fragment_ids)
    if predicate is not None:
        fragments = fragments_for(spark, location, made, fragments, predicate)
    row_ids = bool(options.get("with_row_id"))
    df = live(spark, location, _needed(spark, made.schema, columns, predicate), fragments, row_ids)
    if predicate is not None:
        df = df.where(predicate)
    if columns is not None:
        df = df.select(*(F.col(f"`{c}`") for c in columns), *([ROW_ID] if row_ids else []))
    if override_num_blocks:
        more = override_num_blocks > sum(max(1, (f.bytes or 0) >> 27) for f in fragments)
        df = df.repartition(override_num_blocks) if more else df.coalesce(override_num_blocks)
    return df.coalesce(concurrency) if concurrency else df


def _needed(spark: SparkSession, schema: StructType, columns: list[str] | None, predicate: str | None) -> StructType:
    """The fields that a read speaks of; all if it names no columns."""
    from tessera.plans.prune import conjuncts

    if columns is None:
        return schema
    spoken = {c.lower() for c in columns}
    if predicate is not None:
        named = set().union(*(names for names, _ in conjuncts(spark, predicate)))
        spoken |= {n.lower() for n in named} | {n.split(".")[0].lower() for n in named}
        if "subquery" in predicate.lower() or "select" in predicate.lower():
            return schema
    return StructType([f for f in schema.fields if f.name.lower() in spoken])


def _searched(spark: SparkSession, uri: str, version: int, columns: list[str] | None, predicate: str | None, options: dict) -> DataFrame:
    """The rows of a search given as scanner options, without its score."""
    from tessera.operators import search
    from tessera.table import Table

    table = Table(spark, uri, version=version)
    if options.get("nearest"):
        wanted = dict(options["nearest"])
        found = search.nearest(table, wanted.pop("column"), list(wanted.pop("q")), wanted.pop("k", 10), columns=columns, filter=predicate, **wanted)
        return found.drop("_distance")
    query = options["full_text_query"]
    query = {"query": query} if isinstance(query, str) else query
    column = next(iter(query.get("columns") or []), None)
    found = search.full_text_search(table, query["query"], column=column, phrase=bool(query.get("phrase")), operator=query.get("operator", "or")).drop("_score")
    found = found.where(predicate) if predicate else found
    return found.select(*(F.col(f"`{c}`") for c in columns)) if columns else found


def set_storage(spark: SparkSession, options: dict[str, str] | None) -> None:
    """Hand storage options (fs.* keys) to the session's file systems."""
    for key, value in (options or {}).items():
        spark.sparkContext._jsc.hadoopConfiguration().set(key, str(value))
