"""Evolution, compaction, indices, search, streaming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import tessera as t
from tessera.plans import placement
from tessera.streaming.sink import append_stream


def table(spark, uri, fragments=3, rows=20, text="doc {id} of fragment"):
    df = spark.range(0, fragments * rows, 1, fragments).select("id", F.concat(F.lit("This is document "), "id").alias("text"), (F.col("id") * 1.5).alias("score"))
    t.write_table(df, uri, min_rows_per_file=rows, max_rows_per_file=rows)
    return df


def test_add_columns(spark, tmp_path):
    uri = str(tmp_path / "a")
    table(spark, uri)
    t.Table(spark, uri).delete("id = 5")
    t.add_columns(spark, uri, transform={"twice": "score * 2"})
    t.add_columns(spark, uri, transform=lambda b: pa.RecordBatch.from_arrays([pc.add(b.column("id"), 1)], ["next"]), batch_size=7)
    rows = spark.range(60).select(F.col("id").alias("_rowid")).select(((F.floor(F.col("_rowid") / 20) * 2**32).cast("long") + F.col("_rowid") % 20).alias("_rowid"), F.col("_rowid").alias("place"))
    t.add_columns(spark, uri, transform=rows)
    got = t.read_table(spark, uri)
    assert got.columns == ["id", "text", "score", "twice", "next", "place"]
    assert got.count() == 59
    assert got.where("twice <> score * 2 OR next <> id + 1 OR place <> id OR next IS NULL OR place IS NULL").count() == 0
    t.add_columns(spark, uri, transform=pa.table({"held": list(range(60))}))
    t.add_columns(spark, uri, transform=lambda b: b.to_pandas()[["held"]].rename(columns={"held": "kept"}), read_columns=["held"])
    assert t.read_table(spark, uri).where("held <> id OR kept <> id OR kept IS NULL").count() == 0
    with pytest.raises(ValueError, match="rows for 60"):
        t.add_columns(spark, uri, transform=pa.table({"z": [1]}))
    with pytest.raises(NotImplementedError):
        t.add_columns(spark, uri, transform={"x": "1"}, filter="id > 1")
    with pytest.raises(ValueError, match="exist already"):
        t.add_columns(spark, uri, transform={"id": "1"})
    with pytest.raises(Exception, match="rows for"):
        t.add_columns(spark, uri, transform=lambda b: b.select(["id"]).rename_columns(["y"]).slice(0, 1))


def test_added_columns_lie_in_files_of_their_own(spark, tmp_path):
    uri = str(tmp_path / "a")
    table(spark, uri)
    first = t.Table(spark, uri)
    t.add_columns(spark, uri, transform={"twice": "score * 2", "odd": "id % 2 = 1"})
    t.add_columns(spark, uri, transform={"more": "twice + id"})
    made = t.Table(spark, uri)
    assert [f.path for f in made.fragments()] == [f.path for f in first.fragments()] and [len(f.columns) for f in made.fragments()] == [2, 2, 2]
    files = lambda **o: {name.split("/_fragment=")[0].rsplit("/", 1)[1] for name in t.read_table(spark, uri, **o).inputFiles()}
    folders = [f.columns[k][0].split("/")[1] for f in made.fragments()[:1] for k in (0, 1)]
    assert files(columns=["twice"], filter="odd") == {folders[0]} and files(columns=["more"]) == {folders[1]}
    assert not files(columns=["id"]) & set(folders) and set(folders) < files()
    assert sorted(r.id for r in t.read_table(spark, uri, columns=["id"], filter="odd AND more > 200").collect()) == [i for i in range(60) if i % 2 and 4 * i > 200]
    t.write_table(t.read_table(spark, uri).where("id < 3"), uri, mode="append")
    made = t.create_scalar_index(spark, uri, column="more", index_type="BTREE").delete("more = 40")
    assert made.count_rows() == 62 and made.to_df(filter="more >= 228").count() == 3
    assert [tuple(r) for r in made.take([58, 9], ["id", "more"]).collect()] == [(59, 236.0), (9, 36.0)]
    want = sorted(map(tuple, made.to_df().collect()))
    t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 1, "fold_columns": True, "materialize_deletions": False})
    made = t.Table(spark, uri)
    assert not any(f.columns for f in made.fragments()) and sorted(map(tuple, made.to_df().collect())) == want
    assert first.to_df().columns == ["id", "text", "score"] and first.to_df().count() == 60


@pytest.mark.parametrize(("fragments", "rows", "target", "expected"), [(2, 10, 100, (2, 1)), (40, 5, 20, (40, 10)), (1, 100, 100, None)])
def test_compaction(spark, tmp_path, fragments, rows, target, expected):
    uri = str(tmp_path / "a")
    df = table(spark, uri, fragments, rows)
    got = t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": target, "num_threads": 1})
    assert (got and (got.fragments_removed, got.fragments_added)) == expected
    assert sorted(t.read_table(spark, uri).collect()) == sorted(df.collect())


def test_compaction_materialises_deletions(spark, tmp_path):
    uri = str(tmp_path / "a")
    table(spark, uri, 2, 10)
    t.Table(spark, uri).delete("id < 9")
    got = t.compact_files(spark, uri, compaction_options=t.CompactionOptions(target_rows_per_fragment=100, materialize_deletions_threshold=0.5))
    assert got == t.CompactionMetrics(2, 1)
    assert t.Table(spark, uri).fragments()[0].rows == 11
    with pytest.raises(ValueError, match="num_workers"):
        t.compact_files(spark, uri, num_workers=0)


def test_compaction_by_few_workers(spark, tmp_path):
    uri = str(tmp_path / "a")
    table(spark, uri, 12, 5)
    assert t.compact_files(spark, uri, compaction_options={"target_rows_per_fragment": 10}, num_workers=2) == t.CompactionMetrics(12, 6)
    made = t.Table(spark, uri)
    assert [f.rows for f in made.fragments()] == [10] * 6 and [r.id for r in made.take([0, 11, 59]).collect()] == [0, 11, 59]


def test_planning():
    assert placement.array_split([1, 2, 3, 4, 5], 2) == [[1, 2, 3], [4, 5]]
    assert placement.balanced({1: 10, 2: 9, 3: 1}, 2) == [[1], [2, 3]]
    assert placement.balanced({1: 10}, 3) == [[1]]
    with pytest.raises(ValueError):
        placement.array_split([], 2)


FILTERS = [f"id = {i}" for i in (0, 19, 20, 39, 40, 59, -1, 100)] + ["id >= 15 AND id < 25", "id BETWEEN 0 AND 59", "id < 5", "id > 39", "id <= 41 AND score > 30", "id = 3 OR id = 50", "text = 'This is document 7'"]


def test_btree_never_changes_a_result(spark, tmp_path):
    uri, plain = str(tmp_path / "a"), str(tmp_path / "b")
    table(spark, uri)
    table(spark, plain)
    t.create_scalar_index(spark, uri, column="id", index_type="BTREE", num_workers=2)
    t.create_scalar_index(spark, uri, column="text", index_type="BTREE")
    for f in FILTERS:
        assert sorted(t.read_table(spark, uri, filter=f).collect()) == sorted(t.read_table(spark, plain, filter=f).collect()), f
    assert len(t.read_table(spark, uri, filter="id = 45").inputFiles()) == 1
    assert len(t.read_table(spark, uri, filter="text = 'This is document 7'").inputFiles()) == 1
    # Rows that the index doesn't cover are found, deleted ones are not.
    t.write_table(spark.createDataFrame([(45, "again", 0.0)], "id long, text string, score double"), uri, mode="append")
    assert t.read_table(spark, uri, filter="id = 45").count() == 2
    t.Table(spark, uri).delete("text = 'again'")
    assert t.read_table(spark, uri, filter="id = 45").count() == 1
    t.compact_files(spark, uri)
    assert t.read_table(spark, uri, filter="id = 45").count() == 1


def test_btree_on_a_column_named_like_the_index_has_it(spark, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(spark.range(0, 30, 1, 3).select("id", (F.col("id") / 10).cast("long").alias("fragment_id")), uri, min_rows_per_file=10, max_rows_per_file=10)
    t.create_scalar_index(spark, uri, column="fragment_id", index_type="BTREE")
    found = t.read_table(spark, uri, filter="fragment_id = 2")
    assert found.count() == 10 and len(found.inputFiles()) == 1


@pytest.mark.parametrize("predicate", ["id IN (SELECT 7)", "array_contains(tags, 3)", "array_contains(tags, id)", "size(tags) = 2 AND id < 30", "id = 7 OR id > 55", "id BETWEEN 3 AND 21", "rand() < 2", "id + 1 = 8", "exists(tags, x -> x = 3)", "NOT id <= 50", "id IS NULL", "cast(id AS string) LIKE '5%'"])
def test_indexed_columns_take_any_filter(spark, tmp_path, predicate):
    uri = str(tmp_path / "a")
    t.write_table(spark.range(0, 60, 1, 1).select("id", F.array(F.col("id") % 5, F.lit(9)).alias("tags")), uri, min_rows_per_file=20, max_rows_per_file=20)
    plain = sorted(r.id for r in t.read_table(spark, uri, filter=predicate).collect())
    t.create_scalar_index(spark, uri, column="id", index_type="BTREE")
    t.create_scalar_index(spark, uri, column="tags", index_type="BTREE")
    assert sorted(r.id for r in t.read_table(spark, uri, filter=predicate).collect()) == plain


def test_index_checks(spark, tmp_path):
    uri = str(tmp_path / "a")
    table(spark, uri)
    build = lambda **o: t.create_scalar_index(spark, uri, **{"column": "text", "index_type": "INVERTED"} | o)
    for options, error, match in [
        ({"column": ""}, ValueError, "cannot be empty"), ({"num_workers": 0}, ValueError, "must be positive"), ({"index_type": "NONE"}, ValueError, "must be one of"),
        ({"index_type": "BITMAP"}, ValueError, "supports"), ({"column": "none"}, ValueError, "not found"), ({"column": "id"}, TypeError, "must be string"),
        ({"stemming": True}, ValueError, "stemming"), ({"fragment_ids": [99]}, ValueError, "do not exist"), ({"fragment_ids": []}, ValueError, "empty"),
    ]:
        with pytest.raises(error, match=match):
            build(**options)
    build(name="mine")
    with pytest.raises(ValueError, match="mine.*already exists"):
        build(name="mine", replace=False)
    got = build(name="mine", fragment_ids=[0])
    assert [(i["name"], i["type"], i["fragment_ids"]) for i in got.list_indices()] == [("mine", "Inverted", [0])]


@pytest.mark.parametrize("covered", [None, [0]])
def test_full_text(spark, tmp_path, covered):
    uri = str(tmp_path / "a")
    t.write_table(
        spark.createDataFrame([(1, "Python is fun, Python!"), (2, "This is Rust"), (3, "this and python"), (4, None), (5, "fun is python")], "id long, text string").orderBy("id").coalesce(1),
        uri, min_rows_per_file=2, max_rows_per_file=2,
    )
    table = t.create_scalar_index(spark, uri, column="text", index_type="FTS", with_position=True, fragment_ids=covered)
    find = lambda q, **o: sorted(r.id for r in t.full_text_search(table, q, **o).collect())
    assert find("PYTHON") == [1, 3, 5] and find("this") == [2, 3] and find("absent") == [] and find("") == []
    assert find("python rust") == [1, 2, 3, 5] and find("is python", operator="and") == [1, 5]
    assert find("is python", phrase=True) == [5] and find("python is fun python", phrase=True) == [1]
    top = t.full_text_search(table, "python", limit=1, columns=["id"]).collect()
    assert top[0].id == 1 and top[0]["_score"] > 0
    assert t.read_table(spark, uri, columns=["id"], filter="id > 1", scanner_options={"full_text_query": "fun"}).collect() == [(5,)]
    table.delete("id = 5")
    assert find("fun") == [1]
    plain = t.create_scalar_index(spark, uri, column="text", index_type="INVERTED", remove_stop_words=True)
    assert [r.id for r in t.full_text_search(plain, "this").collect()] == []


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(5).standard_normal((400, 16)).astype(np.float32)


@pytest.mark.parametrize("kind", ["IVF_FLAT", "IVF_SQ", "IVF_PQ", "ivf_hnsw_flat"])
@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_vectors(spark, tmp_path, cloud, kind, metric):
    uri = str(tmp_path / "a")
    t.write_table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "id long, vector array<float>"), uri, min_rows_per_file=100, max_rows_per_file=100)
    table = t.create_index(spark, uri, "vector", kind, num_partitions=4, num_sub_vectors=8, metric=metric)
    assert table.list_indices()[0]["type"] == kind.upper()
    q = cloud[7].astype(float) + 0.01
    unit = cloud / (np.linalg.norm(cloud, axis=1, keepdims=True) if metric == "cosine" else 1)
    d = ((cloud - q) ** 2).sum(1) if metric == "l2" else -(unit @ q)
    exact = np.argsort(d)[:5].tolist()
    assert [r.id for r in t.nearest(table, "vector", q.tolist(), 5, metric=metric, use_index=False).collect()] == exact
    got = [r.id for r in t.nearest(table, "vector", q.tolist(), 5, nprobes=4, refine_factor=20).collect()]
    assert got == exact
    assert len(t.nearest(table, "vector", q.tolist(), 5, nprobes=1).collect()) == 5
    found = t.read_table(spark, uri, columns=["id"], scanner_options={"nearest": {"column": "vector", "q": q, "k": 5, "use_index": False, "metric": metric}})
    assert [r.id for r in found.collect()] == exact and len(table) == 400
    table.delete(f"id = {exact[0]}")
    assert [r.id for r in t.nearest(table, "vector", q.tolist(), 4, nprobes=4, refine_factor=20).collect()] == exact[1:]


@pytest.mark.parametrize("change", ["delete", "compact", "append"])
def test_searches_after_a_change(spark, tmp_path, cloud, change):
    """An index gives what the scan gives, after fragments went or came."""
    uri = str(tmp_path / "a")
    rows = [(i, v.tolist(), f"word{i % 3} common {'x ' * (i % 7)}") for i, v in enumerate(cloud)]
    whole = spark.createDataFrame(rows, "id long, vector array<float>, text string").orderBy("id").coalesce(1)
    t.write_table(whole, uri, min_rows_per_file=100, max_rows_per_file=100)
    t.create_index(spark, uri, "vector", "IVF_FLAT", num_partitions=8)
    table = t.create_scalar_index(spark, uri, column="text", index_type="FTS", with_position=True)
    if change == "append":
        t.write_table(whole.where("id < 50"), uri, mode="append")
    else:
        table.delete("id < 210")
        if change == "compact":
            t.compact_files(spark, uri)
    table, q = t.Table(spark, uri), cloud[399].astype(float).tolist()
    near = lambda **o: [(r.id, round(r["_distance"], 4)) for r in t.nearest(table, "vector", q, 60, columns=["id"], **o).collect()]
    assert near(nprobes=8) == near(use_index=False) and len(near(nprobes=1)) == 60
    bare = str(tmp_path / "b")
    t.write_table(table.to_df(), bare)
    for query, options in (("word1 x", {}), ("common word2", {"operator": "and"}), ("common x", {"phrase": True})):
        scores = lambda table: sorted((r.id, round(r["_score"], 9)) for r in t.full_text_search(table, query, column="text", **options).collect())  # noqa: B023, E731
        assert scores(table) == scores(t.Table(spark, bare)) != []
        top = t.full_text_search(table, query, column="text", limit=3, **options).collect()
        assert [round(r["_score"], 9) for r in top] == sorted((s for _, s in scores(table)), reverse=True)[:3]


def test_vector_training_is_bounded(spark, tmp_path, cloud, monkeypatch):
    """Two levels of centroids, a small sample, and a manifest without vectors in it."""
    from tessera.functions.distance import two_level_kmeans
    from tessera.operators import vector_index

    monkeypatch.setattr(vector_index, "SAMPLE_BYTES", 100 * 16 * 8)
    uri = str(tmp_path / "a")
    t.write_table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "id long, vector array<float>"), uri)
    table = t.create_index(spark, uri, "vector", "IVF_PQ", num_partitions=4, num_sub_vectors=4)
    assert len(table.manifest.dumps()) < 2000 and len(t.nearest(table, "vector", cloud[0].tolist(), 400, nprobes=4).collect()) == 400
    points = np.random.default_rng(1).standard_normal((6000, 4))
    made = two_level_kmeans(points, 1100)
    assert abs(len(made) - 1100) < 60 and np.isfinite(made).all()


def test_vector_checks(spark, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, vector array<float>"), uri)
    for args, error, match in [(("vector", "IVF_X"), ValueError, "must be one of"), (("vector", 3), TypeError, "string"), (("id", "IVF_FLAT"), TypeError, "list of numbers"), (("vector", "IVF_FLAT"), ValueError, "dimensions"), (("none", "IVF_FLAT"), ValueError, "not found")]:
        with pytest.raises(error, match=match):
            t.create_index(spark, uri, *args)
    with pytest.raises(ValueError, match="metric"):
        t.create_index(spark, uri, "vector", "IVF_FLAT", metric="manhattan")


def test_view(spark, tmp_path):
    table(spark, str(tmp_path / "a"))
    t.Table(spark, str(tmp_path / "a")).create_view("made")
    assert spark.sql("SELECT count(*) AS n FROM made WHERE id < 10").first().n == 10


def test_stream(spark, tmp_path):
    (spark.range(10)).write.parquet(str(tmp_path / "in"))
    stream = lambda: append_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    stream()
    spark.range(10, 15).write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    assert sorted(r.id for r in t.read_table(spark, str(tmp_path / "t")).collect()) == list(range(15))
    assert [v["operation"] for v in t.Table(spark, str(tmp_path / "t")).versions()] == ["Overwrite", "Append"]
    assert t.Table(spark, str(tmp_path / "t")).manifest.properties == {"stream.stream": 1}
