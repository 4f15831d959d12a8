import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.types import Mapping, MappingError
from lodeseek.operators.filters import Filter, Op
from lodeseek.plans import search
from lodeseek.plans.request import SearchRequest
from lodeseek.sources import load, shardlog
from lodeseek.sources.table import Conflict, Table
from lodeseek.streaming import ingest

M = Mapping.of("t", id="pk", body="string_seg", n="number", at="date")


def rows(spark, *data):
    return spark.createDataFrame([(i, b, n) for i, b, n in data], "id string, body string, n long")


def state(t):
    return sorted((r.id, r.body, r.n) for r in t.rows().collect())


def test_changes(spark, folder):
    t = Table.create(spark, folder, M)
    assert state(t) == [] and t.everything().columns == ["_docid", "id", "body", "n", "at"]
    seen = []
    t.on_commit(lambda v: seen.append(v.number))
    t.add(rows(spark, ("a", "one", 1), ("b", "two", 2)))
    t.add(rows(spark, ("c", "three", None)))
    t.upsert(rows(spark, ("b", "new", 5), ("b", "newer", 7), ("d", "four", 4)), order_by="n")
    assert state(t) == [("a", "one", 1), ("b", "newer", 7), ("c", "three", None), ("d", "four", 4)]
    again = state(t)
    t.upsert(rows(spark, ("b", "newer", 7), ("d", "four", 4)))
    assert state(t) == again
    assert t.delete_key("a") and not t.delete_key("a") and not t.delete_key("zz")
    assert [x[0] for x in state(t)] == ["b", "c", "d"]
    assert t.max_doc() == 7 and t.everything().count() == 7
    assert seen == list(range(1, 6))
    assert state(t.at(2)) == [("a", "one", 1), ("b", "two", 2), ("c", "three", None)]
    ids = [r._docid for r in t.everything().select("_docid").collect()]
    assert len(ids) == len(set(ids))
    before, every = state(t), sorted(ids)
    t.merge()
    assert state(t) == before and len(t.version().segments) == 1
    assert sorted(r._docid for r in t.everything().select("_docid").collect()) == every
    t.add(rows(spark, ("e", "five", 5)))
    t.merge(purge=True)
    assert t.everything().count() == 4 and [x[0] for x in state(t)] == ["b", "c", "d", "e"]
    same = t.version().number
    assert t.merge().number == same
    t.vacuum()
    assert [x[0] for x in state(Table(spark, folder))] == ["b", "c", "d", "e"] and len(t.versions()) == 1


def test_merging_starts_at_the_first_small_segment(spark, folder):
    t = Table.create(spark, folder, M)
    t.add(spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("body"), F.col("id").alias("n")))
    t.add(rows(spark, ("a", "one", 1)))
    t.add(rows(spark, ("b", "one", 1), ("b", "one", 1)))
    first = t.version().segments[0]
    t.merge(small=50)
    assert t.version().segments[0] == first and [s.rows for s in t.version().segments] == [50, 3]


def test_fields(spark, folder):
    t = Table.create(spark, folder, M)
    t.add(rows(spark, ("a", "one", 1)))
    t.add_field("note", "string")
    t.add_field("size", "number")
    t.add(rows(spark, ("b", "two", 2)).withColumns({"note": F.lit("x"), "size": F.lit(3)}))
    assert [(r.id, r.note, r["size"]) for r in t.rows().orderBy("id").collect()] == [("a", "", None), ("b", "x", 3)]
    with pytest.raises(MappingError):
        t.add_field("note", "string")
    t.drop_field("body")
    t.drop_field("nothing")
    assert "body" not in t.rows().columns
    with pytest.raises(MappingError):
        t.drop_field("id")
    t.merge()
    assert [(r.id, r.note) for r in t.rows().orderBy("id").collect()] == [("a", ""), ("b", "x")]


def test_errors(spark, folder):
    with pytest.raises(MappingError):
        Table.create(spark, folder, Mapping.of("t", a="string"))
    with pytest.raises(LookupError):
        Table(spark, folder).version()
    t = Table.create(spark, folder, M)
    with pytest.raises(MappingError):
        Table.create(spark, folder, M)
    with pytest.raises(MappingError):
        t.add(spark.createDataFrame([("x",)], "body string"))
    v = t.version()
    t.add(rows(spark, ("a", "one", 1)))
    with pytest.raises(Conflict):
        t._commit(v)
    t.destroy()
    assert t.versions() == []


def test_no_rows_are_no_segment(spark, folder):
    t = Table.create(spark, folder, M)
    t.add(spark.createDataFrame([], "id string, body string, n long"))
    t.upsert(spark.createDataFrame([], "id string, body string, n long"))
    assert t.version().segments == () and state(t) == []


def test_index_of_a_table(spark, folder):
    t = Table.create(spark, folder, M)
    t.add(rows(spark, ("a", "red fox", 1), ("b", "red hen", 2)))
    t.add(rows(spark, ("c", "fox", 3), ("d", "red fox red", 4)))
    t.delete_key("a")
    found = t.build_index(4)
    request = SearchRequest(terms=[("body", "red fox")], filters=[Filter("n", Op.OVER, 2)])
    got = search.index_hits(found, M, request, t.max_doc(), t.everything(), t.tombstones(), 4)
    scan = search.hits(t.everything(), M, request, deleted=t.tombstones())
    assert [tuple(r) for r in got.collect()] == [(r._docid, r.weight) for r in scan.collect()] and got.count() == 1
    assert t.index().count() == found.count()
    assert search.index_hits(found, M, SearchRequest(), t.max_doc(), t.everything(), t.tombstones(), 4).count() == 3
    assert search.index_hits(found, M, SearchRequest(terms=[("body", "!")]), t.max_doc(), buckets=4).count() == 0


def test_loading(spark, tmp_path, folder):
    (tmp_path / "in.tsv").write_text("a\tone two\t5\t2015-11-12\nbad line\nb\tthree\tzz\t2015-11-12 23:58:22\nc\t\t\t\nd\tx\t1\t2015-01-01\tmore\n")
    raw = load.delimited(spark, str(tmp_path / "in.tsv"), list(M.fields))
    t = Table.create(spark, folder, M)
    load.load(t, raw, merge=True)
    assert sorted((r.id, r.body, r.n, r.at) for r in t.rows().collect()) == [("a", "one two", 5, dt.datetime(2015, 11, 12)), ("b", "three", None, dt.datetime(2015, 11, 12, 23, 58, 22)), ("c", "", None, None)]
    (tmp_path / "in.psv").write_text("a|b\n")
    assert [tuple(r) for r in load.delimited(spark, str(tmp_path / "in.psv"), ["x", "y"], "|").collect()] == [("a", "b")]
    (tmp_path / "in.json").write_text('{"id": "a", "body": "new", "n": 7, "more": 1}\n{"id": "z"}\nnot json\n[1]\n\n{"id": "q", \n')
    load.load(t, load.json_lines(spark, str(tmp_path / "in.json"), M), replace=True)
    assert sorted((r.id, r.body, r.n) for r in t.rows().collect()) == [("a", "new", 7), ("b", "three", None), ("c", "", None), ("z", "", None)]
    load.push(t, {"id": "z", "body": "pushed", "n": "0x10", "unknown": "x"})
    assert t.rows().where("id = 'z'").first().n == 16


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    source = spark.createDataFrame([(i, f"title {i}", i * 2) for i in range(10)], "user_id int, title string, size int")
    source.write.format("jdbc").option("url", url).option("dbtable", "docs").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    columns = {"user_id": "id", "title": "body"}
    args = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    query = "select * from docs"
    got = load.database(spark, url, query, columns, **args)
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"title {i}") for i in range(10)]
    split = load.database(spark, url, query, columns, "user_id", (0, 10), 3, **args)
    assert sorted(tuple(r) for r in split.collect()) == [(i, f"title {i}") for i in range(10)] and split.rdd.getNumPartitions() == 3


def test_shard_log(spark, folder):
    docs = spark.range(20).select(F.col("id"), F.concat(F.lit("t"), "id").alias("body"))
    shardlog.append(spark, folder, docs, 3, "id", "id")
    shardlog.append(spark, folder, docs.withColumn("id", F.col("id") + 20), 3, "id", "id")
    log = shardlog.read(spark, folder)
    assert log.count() == 40
    got = shardlog.pull(log, 1, 3, 4)
    assert [r.offset for r in got.collect()] == [3, 4, 5, 6]
    assert [json.loads(r.body)["id"] for r in got.collect()] == [10, 13, 16, 19]
    assert shardlog.next_offset(got, 3) == 7 and shardlog.pull(log, 1, 99, 5).count() == 0 and shardlog.next_offset(shardlog.pull(log, 1, 99, 5), 99) == 99
    offsets = {s: sorted(r.offset for r in log.where(F.col("shard") == s).collect()) for s in range(3)}
    assert all(o == list(range(len(o))) for o in offsets.values())
    a, b = (sorted(tuple(r) for r in shardlog.records(docs, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 20


def test_streaming_is_as_batch(spark, tmp_path, folder):
    log, stream = f"file://{tmp_path}/log", f"file://{tmp_path}/stream"
    docs = spark.range(30).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("text "), "id").alias("body"), F.col("id").cast("string").alias("n"))
    shardlog.append(spark, log, docs, 2)
    spark.createDataFrame([(99, "not json", 0), (100, '{"id": "x"}', 0)], "offset long, body string, shard int").write.mode("append").partitionBy("shard").parquet(log)
    t = Table.create(spark, folder, M)
    ingest.ingest(ingest.log_stream(spark, log, 1), t, stream).awaitTermination()
    expect = sorted([(str(i), f"text {i}", i) for i in range(30)] + [("x", "", None)], key=str)
    assert sorted(state(t), key=str) == expect and t.version().batches["log"] >= 1
    # the same batches again, as after a failure that lost the stream's own checkpoint
    ingest.ingest(ingest.log_stream(spark, log, 1), t, stream + "2").awaitTermination()
    assert sorted(state(t), key=str) == expect
    shardlog.append(spark, log, docs.where("id = '3'").withColumn("body", F.lit("late")), 2)
    ingest.ingest(ingest.log_stream(spark, log, 1), t, stream, replace=True).awaitTermination()
    assert len(state(t)) == 31 and t.rows().where("id = '3'").first().body == "late"


def test_binlog(spark):
    m = spark.createDataFrame([("2024-01-02 00:00:01", "b"), ("2024-01-01 00:00:09", "a"), ("2024-01-02 00:00:01", "a"), (None, "n")], "ts string, detail string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [(r.LogId, bytes(r.LogDetail).decode()) for r in ingest.binlog(m, 5).orderBy("LogId").collect()] == [(5, "n"), (6, "a"), (7, "a"), (8, "b")]
