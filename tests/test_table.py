"""Reads, writes, versions, catalog, deletion."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tessera as t
from tessera.sources import manifest, storage
from tessera.sources.manifest import ConflictError

PEOPLE = [(1, "Ann", 25, 1.5), (2, "Bob", 30, 2.5), (3, "Cyd", 35, 3.5), (4, "Dan", 40, 4.5), (5, "Eve", 45, 5.5)]
SCHEMA = "id long, name string, age long, score double"


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, people, tmp_path):
    t.write_table(people, str(tmp_path / "a"))
    assert rows(t.read_table(spark, str(tmp_path / "a"))) == PEOPLE


def test_projection_keeps_the_asked_order(spark, people, tmp_path):
    t.write_table(people, str(tmp_path / "a"))
    df = t.read_table(spark, str(tmp_path / "a"), columns=["score", "id"])
    assert df.columns == ["score", "id"]


@pytest.mark.parametrize(("predicate", "n"), [("age > 30", 3), ("age >= 35", 3), ("name = 'Ann'", 1), ("age > 100", 0)])
def test_filter(spark, people, tmp_path, predicate, n):
    t.write_table(people, str(tmp_path / "a"))
    df = t.read_table(spark, str(tmp_path / "a"), filter=predicate, columns=["id"])
    assert df.count() == n and df.columns == ["id"]


def test_filter_and_columns_reach_the_scan(spark, people, tmp_path):
    t.write_table(people, str(tmp_path / "a"))
    plan = t.read_table(spark, str(tmp_path / "a"), filter="age > 30", columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,30)" in plan and "ReadSchema: struct<id:bigint,age:bigint>" in plan


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        t.read_table(spark, str(tmp_path / "none"))


def test_append_and_overwrite(spark, people, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(people.where("id <= 3"), uri)
    t.write_table(people.where("id > 3"), uri, mode="append")
    assert rows(t.read_table(spark, uri)) == PEOPLE
    t.write_table(people.where("id = 5"), uri, mode="overwrite")
    assert rows(t.read_table(spark, uri)) == PEOPLE[4:]
    assert [v["version"] for v in t.Table(spark, uri).versions()] == [1, 2, 3]
    assert t.read_table(spark, uri, dataset_options={"version": 1}).count() == 3
    assert t.read_table(spark, uri, dataset_options={"version": 2}).count() == 5
    with pytest.raises(ValueError, match="version 9"):
        t.read_table(spark, uri, dataset_options={"version": 9})


def test_append_needs_a_table_and_its_schema(spark, people, tmp_path):
    with pytest.raises(FileNotFoundError):
        t.write_table(people, str(tmp_path / "a"), mode="append")
    t.write_table(people, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="not in the schema"):
        t.write_table(people.withColumn("more", F.lit(1)), str(tmp_path / "a"), mode="append")


def test_schema_cast(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, age double, extra void")
    t.write_table(df, str(tmp_path / "a"), schema=pa.schema([("id", pa.int64()), ("age", pa.int32()), ("extra", pa.string())]))
    got = t.read_table(spark, str(tmp_path / "a"))
    assert got.dtypes == [("id", "bigint"), ("age", "int"), ("extra", "string")] and rows(got) == [(1, 2, None)]
    with pytest.raises(Exception, match="has a fraction"):
        t.write_table(spark.createDataFrame([(1.5,)], "age double"), str(tmp_path / "b"), schema="age int")
    with pytest.raises(ValueError, match="no type"):
        t.write_table(df, str(tmp_path / "c"))


@pytest.mark.parametrize(("low", "high"), [(0, 1), (1, 0), (None, 5), (5, None), (10, 5)])
def test_file_sizes_are_checked(people, tmp_path, low, high):
    with pytest.raises(ValueError, match="rows_per_file"):
        t.write_table(people, str(tmp_path / "a"), min_rows_per_file=low, max_rows_per_file=high)


def test_fragments(spark, people, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(people.repartition(3), uri, min_rows_per_file=1, max_rows_per_file=1)
    assert [f.id for f in t.Table(spark, uri).fragments()] == [0, 1, 2, 3, 4]
    assert t.read_table(spark, uri, fragment_ids=[0, 1]).count() == 2
    assert t.read_table(spark, uri, fragment_ids=[]).count() == 5
    assert t.read_table(spark, uri, fragment_ids=[0, 99]).count() == 1
    ids = {r[0] for r in t.read_table(spark, uri, columns=[], scanner_options={"with_row_id": True}).collect()}
    assert ids == {i << 32 for i in range(5)}


def test_small_files_are_merged(spark, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(spark.range(0, 40, 1, 8), uri, min_rows_per_file=10, max_rows_per_file=10)
    assert [f.rows for f in t.Table(spark, uri).fragments()] == [10, 10, 10, 10]
    assert rows(t.read_table(spark, uri)) == [(i,) for i in range(40)]


def test_empty_input_makes_no_table(spark, people, tmp_path):
    assert t.write_table(people.where("id > 9"), str(tmp_path / "a")) is None
    with pytest.raises(FileNotFoundError):
        t.Table(spark, str(tmp_path / "a"))


def test_nulls(spark, tmp_path):
    data = [(i, None if i % 2 == 0 else f"str-{i}") for i in range(10)]
    t.write_table(spark.createDataFrame(data, "id long, str string"), str(tmp_path / "a"))
    assert sorted(t.read_table(spark, str(tmp_path / "a")).collect()) == data


def test_addresses(spark, people, tmp_path):
    place = {"table_id": ["x"], "namespace_impl": "dir", "namespace_properties": {"root": str(tmp_path)}}
    with pytest.raises(ValueError, match="either"):
        t.read_table(spark)
    with pytest.raises(ValueError, match="both"):
        t.read_table(spark, "x", **place)
    with pytest.raises(ValueError, match="both"):
        t.write_table(people, "x", mode="append", **place)
    with pytest.raises(ValueError, match="unknown implementation"):
        t.read_table(spark, table_id=["x"], namespace_impl="none")
    with pytest.raises(LookupError):
        t.read_table(spark, **place)
    t.write_table(people, **place)
    t.write_table(people, mode="append", **place)
    assert t.read_table(spark, **place).count() == 10
    t.write_table(people, mode="overwrite", **place)
    assert t.Table(spark, **place).count_rows() == 5


def test_rest_catalog(spark, people, tmp_path):
    """Tables by a server's answers; storage options are handed on and renewed before they end."""
    import http.server
    import json
    import threading
    import time

    known, asked = {}, []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            name, action = self.path.split("/")[-2:]
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((name, action, self.headers["x-key"]))
            if action == "declare":
                known[name] = body.get("location") or f"{tmp_path}/{name}"
            made = {"location": known.get(name), "storage_options": {"fs.test.token": str(len(asked)), "expires_at_millis": int(1000 * (time.time() + 61))}}
            self.send_response(200 if name in known else 404)
            self.end_headers()
            self.wfile.write(json.dumps(made).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = {"namespace_impl": "rest", "namespace_properties": {"uri": f"http://127.0.0.1:{server.server_port}", "header.x-key": "me"}, "table_id": ["sales", "people"]}
    try:
        with pytest.raises(LookupError):
            t.read_table(spark, **address)
        t.write_table(people, **address)
        assert t.read_table(spark, **address).count() == 5 and known == {"sales%24people": f"{tmp_path}/sales%24people"}
        token = lambda: int(spark.sparkContext._jsc.hadoopConfiguration().get("fs.test.token"))
        before = token()
        time.sleep(1.5)
        assert t.Table(spark, f"{tmp_path}/sales%24people").count_rows() == 5 and token() > before
        assert {x[1:] for x in asked} == {("describe", "me"), ("declare", "me")}
    finally:
        server.shutdown()
        storage._grants.clear()


def test_delete_take_and_count(spark, people, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(people.union(spark.createDataFrame([(6, None, None, None)], SCHEMA)).orderBy("id").coalesce(1), uri, min_rows_per_file=3, max_rows_per_file=3)
    table = t.Table(spark, uri).delete("age <= 35 AND id <> 1")
    assert sorted(r.id for r in t.read_table(spark, uri).collect()) == [1, 4, 5, 6]
    assert table.count_rows() == 4 and table.count_rows("age > 30") == 2
    assert [r.id for r in table.take([0, 1, 3], columns=["id"]).collect()] == [1, 4, 6]
    assert t.read_table(spark, uri, dataset_options={"version": 1}).count() == 6
    table.delete("id IN (4, 5, 6)")
    assert len(table.fragments()) == 1
    with pytest.raises(IndexError):
        table.take([5])


def test_conflicting_commits(spark, people, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(people, uri)
    one, other = t.Table(spark, uri), t.Table(spark, uri)
    one.delete("id = 1")
    with pytest.raises(ConflictError):
        other.delete("id = 2")
    stale = t.Table(spark, uri, version=1)
    t.write_table(people, uri, mode="append")
    assert stale.version == 1 and t.Table(spark, uri).count_rows() == 9


def test_an_append_to_an_overwritten_table_conflicts(spark, people, tmp_path, monkeypatch):
    from tessera.sources import writer

    uri = str(tmp_path / "a")
    t.write_table(people, uri)
    write = writer.write_files

    def late(*args):
        made = write(*args)
        monkeypatch.setattr(writer, "write_files", write)
        t.write_table(spark.range(3).select("id", F.lit("x").alias("other")), uri, mode="overwrite")
        return made

    monkeypatch.setattr(writer, "write_files", late)
    with pytest.raises(ConflictError, match="columns"):
        t.write_table(people, uri, mode="append", data_storage_version="9")
    assert t.read_table(spark, uri).columns == ["id", "other"] and t.read_table(spark, uri).count() == 3
    t.write_table(spark.range(1).select("id", F.lit("x").alias("other")), uri, mode="append", data_storage_version="9")
    assert t.Table(spark, uri).manifest.properties == {"data_storage_version": "9"}


def test_scan_options(spark, people, tmp_path):
    uri = str(tmp_path / "a")
    t.write_table(people, uri)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = t.read_table(spark, uri, scanner_options={"batch_size": 2}).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    spark.conf.set(key, before)
    assert max(r.n for r in sizes) == 2 and sum(r.n for r in sizes) == 5
    assert t.read_table(spark, uri, override_num_blocks=3).rdd.getNumPartitions() == 3 and t.read_table(spark, uri, concurrency=1).rdd.getNumPartitions() == 1
    for options in ({"scanner_options": {"prefetch": 1}}, {"concurrency": 0}, {"override_num_blocks": -1}):
        with pytest.raises(ValueError, match="prefetch|positive"):
            t.read_table(spark, uri, **options)


def test_files_grow_over_batches(spark, tmp_path):
    """A file holds as many batches as its limits allow."""
    uri, key = str(tmp_path / "a"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    made = t.commit_fragments(spark.range(0, 250, 1, 1).mapInArrow(t.FragmentWriter(uri, max_rows_per_file=100, max_rows_per_group=50), t.FRAGMENT_SCHEMA), uri)
    small = t.commit_fragments(spark.range(0, 250, 1, 1).mapInArrow(t.FragmentWriter(f"{uri}2", max_bytes_per_file=800), t.FRAGMENT_SCHEMA), f"{uri}2")
    spark.conf.set(key, before)
    assert [f.rows for f in made.fragments] == [100, 100, 50] and len(small.fragments) == 3
    assert sorted(r.id for r in t.read_table(spark, uri).collect()) == list(range(250))


def test_a_version_is_created_once(spark, tmp_path):
    assert storage.create_text(spark, f"{tmp_path}/x/1.json", "a")
    assert not storage.create_text(spark, f"{tmp_path}/x/1.json", "b")
    assert storage.read_text(spark, f"{tmp_path}/x/1.json") == "a"
    assert manifest.versions(spark, str(tmp_path)) == []


def test_two_phase_write(spark, tmp_path):
    uri = str(tmp_path / "a")
    df = spark.range(0, 10, 1, 2).select("id", F.concat(F.lit("str-"), "id").alias("str"))
    made = t.commit_fragments(df.mapInArrow(t.FragmentWriter(uri), t.FRAGMENT_SCHEMA), uri)
    assert len(made.fragments) == 2
    writer = t.FragmentWriter(uri, lambda table: (table.slice(i, 1) for i in range(table.num_rows)), schema="id long, str string, more int")
    t.commit_fragments(df.mapInArrow(writer, t.FRAGMENT_SCHEMA), uri, mode="overwrite")
    got = t.read_table(spark, uri)
    assert got.columns == ["id", "str", "more"] and got.count() == 10 and len(t.Table(spark, uri).fragments()) == 2
    t.commit_fragments(df.mapInArrow(t.FragmentWriter(uri, schema="id long, str string, more int", max_rows_per_file=2), t.FRAGMENT_SCHEMA), uri, mode="append")
    assert t.read_table(spark, uri).count() == 20
    assert t.commit_fragments(df.where("id < 0").mapInArrow(t.FragmentWriter(uri), t.FRAGMENT_SCHEMA), str(tmp_path / "b")) is None
