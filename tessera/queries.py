"""The engine's queries over the test tables, each with the SQL that it must agree with.

Every query writes a table of its own into a scratch folder and reads it back through the operator it is
named after. Tables are made once for each application and data folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera as t
from tessera.sources import scratch
from tessera.streaming.sink import append_stream

_made: dict[tuple[str, str, str], str] = {}
ROWS = 4000
Query = Callable[[SparkSession, str], DataFrame]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(name: str, build: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], str]:
    """A table's uri, built at first use."""

    def uri(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _made:
            place = scratch.folder(spark)
            build(spark, sf_dir, place)
            _made[key] = place
        return _made[key]

    return uri


def _copy(name: str, rows: int = ROWS) -> Callable:
    return lambda spark, d, uri: t.write_table(source(spark, d, name), uri, min_rows_per_file=rows, max_rows_per_file=rows)


customers = _table("customer", _copy("customer", 1000))
lines = _table("lineitem", _copy("lineitem", 20_000))


#: The table of two versions gets urgent and high orders first, all others by an append.
EARLIER = "o_orderpriority < '3'"


def _two_versions(spark: SparkSession, d: str, uri: str) -> None:
    orders = source(spark, d, "orders")
    t.write_table(orders.where(EARLIER), uri, min_rows_per_file=ROWS, max_rows_per_file=ROWS)
    t.write_table(orders.where(f"NOT coalesce({EARLIER}, false)"), uri, mode="append", min_rows_per_file=ROWS, max_rows_per_file=ROWS)


two = _table("two versions", _two_versions)


def _replaced(spark: SparkSession, d: str, uri: str) -> None:
    t.write_table(source(spark, d, "orders"), uri)
    t.write_table(source(spark, d, "orders").where("o_totalprice > 200000"), uri, mode="overwrite")


overwritten = _table("overwritten", _replaced)


def _doubled(table: pa.Table) -> pa.Table:
    import pyarrow.compute as pc

    return table.append_column("doubled", pc.multiply(table["event_id"], 2))


def _phases(transform: Callable | None) -> Callable:
    def build(spark: SparkSession, d: str, uri: str) -> None:
        rows = source(spark, d, "events").select("event_id", "user_id", "event_type", "value")
        t.commit_fragments(rows.mapInArrow(t.FragmentWriter(uri, transform), t.FRAGMENT_SCHEMA), uri)

    return build


written = _table("fragments", _phases(None))
transformed = _table("transformed", _phases(_doubled))


def _by_catalog(spark: SparkSession, d: str, uri: str) -> None:
    t.write_table(source(spark, d, "supplier"), table_id=["sales", "supplier"], namespace_impl="dir", namespace_properties={"root": uri})


catalog = _table("catalog", _by_catalog)


def _evolved_sql(spark: SparkSession, d: str, uri: str) -> None:
    _copy("customer", 1000)(spark, d, uri)
    t.add_columns(spark, uri, transform={"balance2": "c_acctbal * 2", "rich": "c_acctbal > 5000"})


def _twice(batch: pa.RecordBatch) -> pa.RecordBatch:
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([pc.multiply(batch.column("c_acctbal"), 2.0)], ["balance2"])


def _evolved_udf(spark: SparkSession, d: str, uri: str) -> None:
    _copy("customer", 1000)(spark, d, uri)
    t.add_columns(spark, uri, transform=_twice, read_columns=["c_acctbal"])


with_sql = _table("evolved by SQL", _evolved_sql)
with_udf = _table("evolved by function", _evolved_udf)


def _deleted(spark: SparkSession, d: str, uri: str) -> None:
    _copy("lineitem", 10_000)(spark, d, uri)
    t.Table(spark, uri).delete("l_quantity > 25")


def _compacted(spark: SparkSession, d: str, uri: str) -> None:
    _copy("orders", 1000)(spark, d, uri)
    t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 1_000_000_000})


def _deleted_compacted(spark: SparkSession, d: str, uri: str) -> None:
    _deleted(spark, d, uri)
    t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 1_000_000_000})


deleted = _table("deleted", _deleted)
compacted = _table("compacted", _compacted)
deleted_compacted = _table("deleted and compacted", _deleted_compacted)


def _btree(name: str, column: str) -> Callable:
    def build(spark: SparkSession, d: str, uri: str) -> None:
        _copy(name, 1000)(spark, d, uri)
        t.create_scalar_index(spark, uri, column=column, index_type="BTREE")

    return build


events = _table("events by id", _btree("events", "event_id"))
names = _table("customers by name", _btree("customer", "c_name"))


def _inverted(spark: SparkSession, d: str, uri: str) -> None:
    t.write_table(source(spark, d, "documents").select("doc_id", "text"), uri, min_rows_per_file=ROWS, max_rows_per_file=ROWS)
    t.create_scalar_index(spark, uri, column="text", index_type="INVERTED", with_position=True)


documents = _table("documents", _inverted)


def _ivf(kind: str | None, **options: object) -> Callable:
    def build(spark: SparkSession, d: str, uri: str) -> None:
        t.write_table(source(spark, d, "embeddings"), uri, min_rows_per_file=200, max_rows_per_file=200)
        if kind:
            t.create_index(spark, uri, "embedding", kind, num_partitions=4, sample_rate=64, **options)

    return build


vectors = _table("vectors", _ivf(None))
ivf = {kind: _table(kind, _ivf(kind, **({"num_sub_vectors": 16} if "PQ" in kind else {}))) for kind in ("IVF_FLAT", "IVF_SQ", "IVF_PQ", "IVF_HNSW_FLAT", "IVF_HNSW_SQ", "IVF_HNSW_PQ")}


def _vectors_changed(spark: SparkSession, d: str, uri: str) -> None:
    """An indexed table of which rows and a whole fragment went, the rest was compacted, and some rows came back."""
    _ivf("IVF_FLAT")(spark, d, uri)
    table = t.Table(spark, uri)
    first = table.to_df(fragment_ids=[table.fragments()[0].id]).agg(F.min("vec_id"), F.max("vec_id")).first()
    table.delete(f"vec_id % 3 = 0 OR vec_id BETWEEN {first[0]} AND {first[1]}")
    t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 150})
    t.write_table(source(spark, d, "embeddings").where(f"vec_id BETWEEN {first[0]} AND {first[1]} AND vec_id % 3 <> 0"), uri, mode="append")


vectors_changed = _table("vectors changed", _vectors_changed)


def _documents_changed(spark: SparkSession, d: str, uri: str) -> None:
    t.write_table(source(spark, d, "documents").select("doc_id", "text"), uri, min_rows_per_file=200, max_rows_per_file=200)
    t.create_scalar_index(spark, uri, column="text", index_type="INVERTED", with_position=True)
    t.Table(spark, uri).delete("doc_id % 4 = 1 OR doc_id < 300")
    t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 100})


documents_changed = _table("documents changed", _documents_changed)


def _tagged(spark: SparkSession, d: str, uri: str) -> None:
    rows = source(spark, d, "events").select("event_id", F.array(F.col("event_id") % 7, F.col("user_id") % 5).alias("tags"))
    t.write_table(rows, uri, min_rows_per_file=1000, max_rows_per_file=1000)
    t.create_scalar_index(spark, uri, column="tags", index_type="BTREE")


tagged = _table("tagged", _tagged)


def _folded(spark: SparkSession, d: str, uri: str) -> None:
    _evolved_sql(spark, d, uri)
    t.add_columns(spark, uri, transform=t.read_table(spark, uri, columns=["c_custkey"], scanner_options={"with_row_id": True}).select("_rowid", (F.col("c_custkey") + 1).alias("next")))
    t.compact_files(spark, uri, compaction_options={"fold_columns": True})


folded = _table("folded", _folded)


def _rolled(spark: SparkSession, d: str, uri: str) -> None:
    rows = source(spark, d, "events").select("event_id", "user_id").coalesce(1)
    t.commit_fragments(rows.mapInArrow(t.FragmentWriter(uri, max_rows_per_file=3000), t.FRAGMENT_SCHEMA), uri)


rolled = _table("rolled", _rolled)


def _bits(spark: SparkSession, d: str, uri: str) -> None:
    rows = source(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 1000).cast("bigint")).alias("bits"))
    t.write_table(rows, uri)


bit_vectors = _table("bits", _bits)
#: Every search looks for the same point: 64 values between -0.25 and 0.25.
POINT = [((i * 37) % 64 - 32) / 128 for i in range(64)]
BIT_POINT = [(i * 37) % 64 for i in range(64)]


def _streamed(spark: SparkSession, d: str, uri: str) -> None:
    rows = source(spark, d, "events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    append_stream(stream, f"{uri}/table", f"{uri}/checkpoint").awaitTermination()


streamed = _table("streamed", _streamed)

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def _query(name: str, run: Query, sql: str | None) -> None:
    _QUERIES[name] = (run, sql)


_query("scan_all", lambda s, d: t.read_table(s, lines(s, d)), "SELECT * FROM lineitem")
_query("scan_columns", lambda s, d: t.read_table(s, lines(s, d), columns=["l_shipdate", "l_orderkey"]), "SELECT l_shipdate, l_orderkey FROM lineitem")
_query("scan_filter", lambda s, d: t.read_table(s, lines(s, d), filter="l_quantity >= 45 AND l_returnflag = 'R'"), "SELECT * FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
_query("scan_columns_filter", lambda s, d: t.read_table(s, lines(s, d), columns=["l_orderkey"], filter="l_discount > 0.05 AND l_tax IS NOT NULL"), "SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05 AND l_tax IS NOT NULL")
_query("scan_filter_count", lambda s, d: t.read_table(s, lines(s, d), filter="l_quantity < 10").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
_query("scan_scanner_options", lambda s, d: t.read_table(s, customers(s, d), scanner_options={"columns": ["c_custkey"], "filter": "c_acctbal < 0"}), "SELECT c_custkey FROM customer WHERE c_acctbal < 0")


def _first_fragments(s: SparkSession, d: str) -> DataFrame:
    ids = [f.id for f in t.Table(s, two(s, d), version=1).fragments()]
    return t.read_table(s, two(s, d), fragment_ids=ids)


_query("scan_fragment_subset", _first_fragments, f"SELECT {ORDERS} FROM orders WHERE {EARLIER}")
_query("scan_row_ids", lambda s, d: t.read_table(s, lines(s, d), columns=["l_orderkey"], scanner_options={"with_row_id": True}).agg(F.countDistinct("_rowid").alias("n")), "SELECT count(*) AS n FROM lineitem")
_query("write_roundtrip", lambda s, d: t.read_table(s, customers(s, d)), "SELECT * FROM customer")


def _cast(s: SparkSession, d: str) -> DataFrame:
    place = scratch.folder(s)
    t.write_table(source(s, d, "customer").select("c_custkey", "c_nationkey"), place, schema="c_custkey int, c_nationkey long, extra string")
    return t.read_table(s, place)


_query("write_schema_cast", _cast, "SELECT c_custkey::INT AS c_custkey, c_nationkey::BIGINT AS c_nationkey, NULL::VARCHAR AS extra FROM customer")
_query("write_overwrite", lambda s, d: t.read_table(s, overwritten(s, d)), f"SELECT {ORDERS} FROM orders WHERE o_totalprice > 200000")
_query("write_append", lambda s, d: t.read_table(s, two(s, d)), f"SELECT {ORDERS} FROM orders")
_query("time_travel_v1", lambda s, d: t.read_table(s, two(s, d), dataset_options={"version": 1}), f"SELECT {ORDERS} FROM orders WHERE {EARLIER}")
_query("time_travel_v2", lambda s, d: t.read_table(s, two(s, d), dataset_options={"version": 2}), f"SELECT {ORDERS} FROM orders")
_query(
    "versions_list",
    lambda s, d: s.createDataFrame([(v["version"], v["operation"]) for v in t.Table(s, two(s, d)).versions()], "version long, operation string"),
    "SELECT * FROM (VALUES (1::BIGINT, 'Overwrite'), (2::BIGINT, 'Append')) AS v(version, operation)",
)
_query("count_rows", lambda s, d: s.createDataFrame([(t.Table(s, lines(s, d)).count_rows(),)], "n long"), "SELECT count(*) AS n FROM lineitem")
_query("fragment_writer_commit", lambda s, d: t.read_table(s, written(s, d)), "SELECT event_id, user_id, event_type, value FROM events")
_query("fragment_writer_transform", lambda s, d: t.read_table(s, transformed(s, d)), "SELECT event_id, user_id, event_type, value, event_id * 2 AS doubled FROM events")
_query("catalog_roundtrip", lambda s, d: t.read_table(s, table_id=["sales", "supplier"], namespace_impl="dir", namespace_properties={"root": catalog(s, d)}), "SELECT * FROM supplier")
_query("add_columns_sql", lambda s, d: t.read_table(s, with_sql(s, d)), "SELECT *, c_acctbal * 2 AS balance2, c_acctbal > 5000 AS rich FROM customer")
_query("add_columns_udf", lambda s, d: t.read_table(s, with_udf(s, d)), "SELECT *, c_acctbal * 2 AS balance2 FROM customer")
_query("add_columns_projection", lambda s, d: t.read_table(s, with_sql(s, d), columns=["c_custkey", "rich"], filter="balance2 > 1000"), "SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer WHERE c_acctbal * 2 > 1000")
_query("add_columns_folded", lambda s, d: t.read_table(s, folded(s, d)), "SELECT *, c_acctbal * 2 AS balance2, c_acctbal > 5000 AS rich, c_custkey + 1 AS next FROM customer")
_query(
    "fragment_writer_rolls",
    lambda s, d: s.createDataFrame([(len(t.Table(s, rolled(s, d)).fragments()), t.Table(s, rolled(s, d)).count_rows())], "fragments long, n long"),
    "SELECT ceil(count(*) / 3000)::BIGINT AS fragments, count(*) AS n FROM events",
)
_query("delete_rows", lambda s, d: t.read_table(s, deleted(s, d)), "SELECT * FROM lineitem WHERE NOT coalesce(l_quantity > 25, false)")
_query("compact_preserves", lambda s, d: t.read_table(s, compacted(s, d)), f"SELECT {ORDERS} FROM orders")
_query("compact_after_delete", lambda s, d: t.read_table(s, deleted_compacted(s, d)), "SELECT * FROM lineitem WHERE NOT coalesce(l_quantity > 25, false)")
_query(
    "compact_fragments",
    lambda s, d: s.createDataFrame([(len(t.Table(s, compacted(s, d)).fragments()), t.Table(s, compacted(s, d)).count_rows())], "fragments long, n long"),
    "SELECT 1::BIGINT AS fragments, count(*) AS n FROM orders",
)
for _name, _filter in {
    "btree_eq": "event_id = 42",
    "btree_range": "event_id >= 250 AND event_id < 260",
    "btree_cross_fragment": "event_id > 990 AND event_id <= 1010",
    "btree_miss": "event_id = -1",
    "btree_in": "event_id IN (0, 499, 500, 999) AND value IS NOT NULL",
}.items():
    _query(_name, lambda s, d, f=_filter: t.read_table(s, events(s, d), filter=f), f"SELECT * FROM events WHERE {_filter}")
_query("btree_string", lambda s, d: t.read_table(s, names(s, d), filter="c_name = 'Customer#000000042'"), "SELECT * FROM customer WHERE c_name = 'Customer#000000042'")

for _name, _filter in {"btree_list": "array_contains(tags, 3)", "btree_other_filters": "exists(tags, x -> x = 3) AND event_id < 500"}.items():
    _sql_filter = {"btree_list": "list_contains(tags, 3)", "btree_other_filters": "list_contains(tags, 3) AND event_id < 500"}[_name]
    _query(_name, lambda s, d, f=_filter: t.read_table(s, tagged(s, d), columns=["event_id"], filter=f), f"SELECT event_id FROM (SELECT event_id, [event_id % 7, user_id % 5] AS tags FROM events) WHERE {_sql_filter}")

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_find = lambda query, **o: lambda s, d: t.full_text_search(t.Table(s, documents(s, d)), query, columns=["doc_id"], **o).drop("_score")
_query("fts_term", _find("license"), f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'license')")
_query("fts_any", _find("license moron"), f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['license', 'moron'])")
_query("fts_all", _find("the MIT", operator="and"), f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'mit'])")
_query("fts_phrase", _find("the mit license", phrase=True), f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' the mit license ')")
_top = lambda uri: lambda s, d: t.full_text_search(t.Table(s, uri(s, d)), "license moron", columns=["doc_id"], limit=20).select(F.round("_score", 4).alias("score"))
_top_sql = lambda kept: f"""
    WITH w AS (SELECT doc_id, {_TOKENS} AS words FROM documents WHERE {kept}),
    c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
    q AS (SELECT token, (SELECT count(*) FROM w WHERE list_contains(words, token)) AS df FROM (VALUES ('license'), ('moron')) AS v(token)),
    p AS (SELECT doc_id, token, df, len(list_filter(words, lambda x: x = token)) AS tf, len(words) AS size FROM w, q)
    SELECT round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score
    FROM p, c WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC LIMIT 20
    """  # noqa: E731
_query("fts_bm25_topk", _top(documents), _top_sql("true"))
_query("fts_bm25_after_changes", _top(documents_changed), _top_sql("NOT coalesce(doc_id % 4 = 1 OR doc_id < 300, false)"))

_POINT = "[" + ", ".join(str(x) for x in POINT) + "]::DOUBLE[]"
_V = "embedding::DOUBLE[]"
_DISTANCES = {"l2": f"list_distance({_V}, {_POINT}) ^ 2", "cosine": f"1 - list_cosine_similarity({_V}, {_POINT})", "dot": f"1 - list_inner_product({_V}, {_POINT})"}


def _near(uri: Callable, column: str = "embedding", point: list = POINT, k: int = 10, **options: object) -> Query:
    return lambda s, d: t.nearest(t.Table(s, uri(s, d)), column, point, k, columns=["vec_id"], **options).select("vec_id", F.round("_distance", 4).alias("distance"))


def _near_sql(distance: str, k: int = 10) -> str:
    return f"SELECT vec_id, round({distance}, 4) AS distance FROM embeddings ORDER BY {distance}, vec_id LIMIT {k}"


for _metric, _sql in _DISTANCES.items():
    _query(f"knn_{_metric}", _near(vectors, metric=_metric), _near_sql(_sql))
_query(
    "knn_hamming",
    lambda s, d: _near(bit_vectors, "bits", BIT_POINT, 1, metric="hamming")(s, d).select("distance"),
    f"""
    SELECT min(d)::DOUBLE AS distance FROM (
      SELECT vec_id, sum(bit_count(xor(trunc(abs(x::DOUBLE) * 1000)::BIGINT, p::BIGINT))) AS d
      FROM (SELECT vec_id, unnest(embedding) AS x, unnest({BIT_POINT}) AS p FROM embeddings) GROUP BY vec_id)
    """,
)
for _kind, _uri in ivf.items():
    _all = {"nprobes": 4} if "FLAT" in _kind else {"nprobes": 4, "refine_factor": 50}
    _query(f"{_kind.lower()}_all_probes", _near(_uri, **_all), _near_sql(_DISTANCES["l2"]))
_query("ivf_after_changes", _near(vectors_changed, nprobes=4), f"SELECT vec_id, round({_DISTANCES['l2']}, 4) AS distance FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY {_DISTANCES['l2']}, vec_id LIMIT 10")
_query("fragment_stats", lambda s, d: s.createDataFrame([(sum(f.rows for f in t.Table(s, two(s, d)).fragments()),)], "n long"), "SELECT count(*) AS n FROM orders")
_query(
    "list_indices",
    lambda s, d: s.createDataFrame([(i["name"], i["type"]) for u in (events, documents) for i in t.Table(s, u(s, d)).list_indices()], "name string, type string"),
    "SELECT * FROM (VALUES ('event_id_idx', 'BTree'), ('text_idx', 'Inverted')) AS v(name, type)",
)
_query("stream_append", lambda s, d: t.read_table(s, f"{streamed(s, d)}/table"), "SELECT * FROM events")


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
