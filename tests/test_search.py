import json
import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.types import Mapping, MappingError
from lodeseek.operators import aggregate, paging, postings, project, setops
from lodeseek.operators.aggregate import Statistic
from lodeseek.operators.filters import Filter, Op, condition, matching
from lodeseek.plans import search
from lodeseek.plans.request import ParameterError, SearchRequest, parse

M = Mapping.of("t", id="pk", body="string_seg", kind="string", tags="string_list", code="string_single", n="number", at="date")


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (0, "0", "red widget red", "x", "a;b", "red widget", 1, "2015-01-01"),
        (1, "1", "red ring", "y", "b;;c", "blue ring", 5, "2015-06-01"),
        (2, "2", "Widget, blue!", "x", "", "redder", None, None),
        (3, "3", "", "", "a", "", 9, "2016-01-01"),
        (4, "4", None, None, None, None, None, None),
        (5, "5", "red widget blue ring", "y", "c", "get red", 5, "2015-06-01"),
    ]
    return spark.createDataFrame(data, "_docid long, id string, body string, kind string, tags string, code string, n long, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).cache()


def ids(df):
    return sorted(r[0] for r in df.select("_docid").collect())


def found(rows, *terms, where=(), **how):
    return ids(search.hits(rows, M, SearchRequest(terms=list(terms), filters=list(where)), **how))


@pytest.mark.parametrize(
    ("f", "expect"),
    [
        (Filter("n", Op.EQ, 5), [1, 5]),
        (Filter("n", Op.OVER, 5), [1, 3, 5]),
        (Filter("n", Op.OVER, 5, strict=True), [3]),
        (Filter("n", Op.LESS, 5), [0, 1, 5]),
        (Filter("n", Op.LESS, 5, strict=True), [0]),
        (Filter("n", Op.RANGE, 1, 9), [0, 1, 3, 5]),
        (Filter("n", Op.NOT, 5), [0, 3]),
        (Filter("n", Op.EQ, values=(1, 9)), [0, 3]),
        (Filter("n", Op.NOT, values=(1, 9)), [1, 2, 4, 5]),
        (Filter("at", Op.RANGE, "2015-06-01", "2016-01-01"), [1, 3, 5]),
        (Filter("at", Op.OVER, "2016-01-01"), [3]),
        (Filter("at", Op.NOT, values=("2015-06-01",)), [0, 2, 3, 4]),
        (Filter("code", Op.STR_PREFIX, values=("blue", "red")), [0, 1, 2]),
        (Filter("code", Op.STR_PREFIX, "blue,red"), [0, 1, 2]),
        (Filter("code", Op.STR_SUFFIX, values=("ring", "get")), [0, 1]),
        (Filter("code", Op.STR_CONTAINS_ALL, values=("red", "get")), [0, 5]),
        (Filter("code", Op.STR_CONTAINS_ALL, values=("red", "blue")), []),
        (Filter("code", Op.STR_EQUALS_ANY, values=("redder", "x")), [2]),
        (Filter("kind", Op.STR_PREFIX, values=("x",)), []),
        (Filter("n", Op.STR_PREFIX, values=("1",)), []),
        (Filter("kind", Op.EQ, "x"), []),
    ],
)
def test_filters(rows, f, expect):
    assert found(rows, where=(f,)) == expect


def test_unknown_filter_field(rows):
    with pytest.raises(MappingError):
        matching(rows, [Filter("nothing", Op.EQ, 1)], M)


def test_filters_reach_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(condition(Filter("n", Op.RANGE, 1, 5), M)).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,1)" in plan and "ReadSchema: struct<id:string,n:bigint>" in plan


@pytest.mark.parametrize(
    ("terms", "expect"),
    [
        ([("body", "RED")], [0, 1, 5]),
        ([("body", "red widget")], [0, 5]),
        ([("body", "red"), ("kind", "y")], [1, 5]),
        ([("kind", "")], [3]),
        ([("tags", "b")], [0, 1]),
        ([("tags", "c;b")], [1]),
        ([("tags", "")], [1, 2]),
        ([("code", "dg")], [0, 5]),
        ([("body", "!!")], []),
        ([("body", "")], []),
        ([], [0, 1, 2, 3, 4, 5]),
    ],
)
def test_terms(rows, terms, expect):
    assert found(rows, *terms) == expect


def expected_weight(bodies, order, alive, total):
    def toks(t):
        return t.lower().replace(",", " ").replace("!", " ").split()

    out = {}
    dfs = {t: sum(t in toks(bodies[i]) for i in alive) for t in order}
    for i in alive:
        t = toks(bodies[i])
        if all(x in t for x in order):
            w = math.floor(t.count(order[0]) / len(t) * 10000)
            for x in order[1:]:
                w += math.floor(w * math.log10(total / dfs[x]))
            out[i] = w
    return out


def test_weights_follow_filters_deletions_and_order(rows):
    bodies = {r._docid: r.body or "" for r in rows.collect()}
    gone = rows.where("_docid = 1")
    for order in (["red", "widget"], ["widget", "red"], ["blue", "red", "widget"]):
        request = SearchRequest(terms=[("body", " ".join(order))], filters=[Filter("n", Op.OVER, 1)])
        got = search.hits(rows, M, request, deleted=gone)
        assert {r._docid: r.weight for r in got.collect()} == expected_weight(bodies, order, [0, 3, 5], 6)
        index = postings.postings(rows, M)
        again = search.index_hits(index, M, request, 6, rows, gone)
        assert {r._docid: r.weight for r in again.collect()} == expected_weight(bodies, order, [0, 3, 5], 6)


def test_stored_postings_prune(spark, rows, folder):
    postings.write_postings(postings.postings(rows, M), folder, 8)
    index = postings.read_postings(spark, folder)
    for f, t in (("body", "red"), ("tags", "b"), ("code", "r"), ("kind", "x")):
        one = postings.lookup(index, f, t, 8)
        assert ids(one) == found(rows, (f, t))
        plan = one._jdf.queryExecution().toString()
        assert f"bucket#{''}" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    many = postings.lookup_any(index, "body", ["red", "ring"], 8)
    assert {(r.term, r._docid) for r in many.collect()} == {("red", 0), ("red", 1), ("red", 5), ("ring", 1), ("ring", 5)}


def test_hand_written_postings(spark):
    p = spark.createDataFrame([("f", "abc", 0, 10), ("f", "abc", 2, 12), ("f", "abc", 3, 13), ("f", "a", 2, 14), ("f", "a", 9, 19), ("f", "b", 4, 14), ("f", "b", 9, 19)], "field string, term string, _docid long, weight long")
    assert [tuple(r) for r in postings.lookup(p, "f", "abc").orderBy("_docid").collect()] == [(0, 10), (2, 12), (3, 13)]
    assert postings.lookup(p, "f", "c").count() == 0
    lists = postings.posting_lists(p)
    assert lists.where("term = 'abc'").first().df == 3
    assert tuple(postings.nth(p, "abc", 2).first()) == (3, 13) and postings.nth(p, "abc", 3).count() == 0
    a, b = postings.lookup(p, "f", "a"), postings.lookup(p, "f", "b")
    assert [tuple(r) for r in setops.intersection(a, b).collect()] == [(9, 19)]
    assert sorted(tuple(r) for r in setops.union(a, b).collect()) == [(2, 14), (4, 14), (9, 19)]
    assert sorted(tuple(r) for r in setops.union_of_postings(a, a.withColumn("weight", F.col("weight") + 1)).collect()) == [(2, 14), (2, 15), (9, 19), (9, 20)]
    assert [tuple(r) for r in setops.difference(a, b).collect()] == [(2, 14)]


def test_keywords(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("dfdsf"), "id").alias("field1"), F.array(F.lit("1112"), F.concat(F.lit("2222f"), "id"), F.lit("1112")).alias("field2"))
    p = postings.keyword_postings(df, "id", "field2")
    assert postings.lookup(p, "field2", "1112").count() == 100
    assert ids(postings.lookup(postings.keyword_postings(df, "id", "field1"), "field1", "dfdsf7")) == [7]


def test_pages(spark, rows):
    assert paging.page_numbers("x", "7") == (10, 1) and paging.page_numbers("7", "") == (10, 1)
    assert paging.page_numbers("0", "3") == (10, 3) and paging.page_numbers("5", "-1") == (5, 1)
    df = spark.range(1, 13).orderBy("id")
    assert [r[0] for r in paging.page(df, 5, 3).collect()] == [11, 12]
    assert paging.page(df, 5, 4).count() == 0
    with pytest.raises(paging.NotFound):
        paging.page_or_fail(df, 12, 5, 4)
    assert paging.bounds(12, 5, 3) == (11, 12) and paging.bounds(12, 5, 4) == (0, 0)


def test_facets_sum_up_to_the_total(rows):
    request = SearchRequest(terms=[("body", "red")], gather=["kind", "tags"])
    got = search.hits(rows, M, request)
    by = search.facets(got, request).collect()
    assert sum(r.n for r in by if r.field == "kind") == got.count() == 3
    assert {(r.value, r.n) for r in aggregate.gather(got, "kind").select(F.col("kind").alias("value"), "n").collect()} == {("x", 1), ("y", 2)}


@pytest.mark.parametrize(("op", "expect"), [("count", {"x": 2, "y": 2, "": 1, None: 1}), ("sum", {"x": 1, "y": 10, "": 9, None: None}), ("avg", {"x": 1.0, "y": 5.0, "": 9.0, None: None}), ("max", {"x": 1, "y": 5, "": 9, None: None}), ("min", {"x": 1, "y": 5, "": 9, None: None})])
def test_statistics(rows, op, expect):
    assert {r.kind: r.value for r in aggregate.statistics(rows, Statistic(op, "n", "kind")).collect()} == expect


def test_statistics_afterwards(rows):
    def kinds(op, a, b=None):
        return {r.kind for r in aggregate.statistics(rows, Statistic("sum", "n", "kind", op, a, b)).collect()}

    assert kinds(Op.OVER, 9) == {"y", ""} and kinds(Op.LESS, 9) == {"x", ""} and kinds(Op.RANGE, 2, 9) == {""} and kinds(Op.NOT, 9) == {"x", "y"} and kinds(Op.EQ, 10) == {"y"}
    with pytest.raises(ValueError):
        aggregate.statistics(rows, Statistic("median", "n", "kind"))
    r = aggregate.statistics_map(rows, Statistic("sum", "n", "kind")).first()
    assert r.result_count == 3 and r.result == {"": 9, "x": 1, "y": 10}


def test_contacts(rows):
    assert tuple(aggregate.contacts(rows.where("n = 5"), "_docid").first()) == (2, [1, 5])
    assert tuple(aggregate.contact_flags(rows, "id", "0", F.col("n") > 3).first()) == (True, False)
    assert tuple(aggregate.contact_flags(rows, "id", "zz", F.col("n") > 3).first()) == (False, False)


def test_parameters(rows):
    r = parse({"index": "t", "ps": "2", "pg": "1", "body": "red", "-n": "5,1", "gather": "kind", "show": "id,n"}, M)
    assert (r.page_size, r.page, r.gather, r.show) == (2, 1, ["kind"], ["id", "n"])
    assert ids(search.hits(rows, M, r)) == [0, 1, 5]
    assert ids(search.hits(rows, M, parse({"ps": "1", "pg": "1", "_n": "5"}, M))) == [0, 2, 3, 4]
    assert ids(search.hits(rows, M, parse({"ps": "1", "pg": "1", "~at": "2015-01-01,2015-12-31"}, M))) == [0, 1, 5]
    assert ids(search.hits(rows, M, parse({"ps": "1", "pg": "1", ">n": "0x5", "<n": "8"}, M))) == [1, 5]
    for bad in ({"-n": "abc"}, {"-n": ","}, {"~n": "1"}):
        with pytest.raises(ParameterError):
            parse({"ps": "1", "pg": "1"} | bad, M)
    with pytest.raises(ParameterError):
        parse({"body": "red"}, M)
    with pytest.raises(MappingError):
        parse({"ps": "1", "pg": "1", "nothing": "x"}, M)
    sharded = rows.withColumn("_shard", F.col("_docid") % 2)
    assert ids(search.hits(sharded, M, parse({"ps": "1", "pg": "1", "_force": "1", "_shard": "1", "body": "red"}, M))) == [1, 5]


def test_answers(rows):
    request = SearchRequest(terms=[("body", "red")], gather=["kind"], show=["id", "nothing"], page_size=2)
    said = json.loads(search.response(search.hits(rows, M, request), M, request).first().json)
    assert said["totalCount"] == 3 and (said["from"], said["to"], said["status"]) == (1, 2, "OK")
    assert said["dataDetail"] == [{"id": "0", "nothing": ""}, {"id": "1", "nothing": ""}]
    assert said["gather"] == {"kind": [{"value": "x", "n": 1}, {"value": "y", "n": 2}]}
    request = SearchRequest(terms=[("body", "red")], page=9)
    said = json.loads(search.response(search.hits(rows, M, request), M, request).first().json)
    assert said["status"] == "not found" and said["dataDetail"] == []


def test_documents(rows):
    assert project.get_document(rows, M, 2).first().asDict() == {"_docid": 2, "body": "Widget, blue!", "kind": "x", "tags": "", "code": "redder", "n": "", "at": ""}
    assert project.get_fields(rows, M, 2, ["zz"]).count() == 0
    assert project.get_fields(rows, M, 2, ["zz", "kind"]).first().asDict() == {"_docid": 2, "zz": "", "kind": "x"}
    small = rows.limit(0)
    assert search.response(search.hits(small, M, SearchRequest(terms=[("body", "a b")])), M, SearchRequest()).count() == 1
