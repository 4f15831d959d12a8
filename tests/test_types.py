import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.functions import analysis
from lodeseek.functions.types import FieldType, Mapping, MappingError, fixed_point, known, parse_date, parse_number, show_value


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"s {kind}").select(f(F.col("s"))).collect()]


def test_numbers(spark):
    cases = {
        "0x1F": 31, "010": 8, "0b101": 5, "0o17": 15, "-7": -7, "+5": 5, "12": 12, "0": 0, "1_000": 1000, "0xFF_FF": 65535, "-0x10": -16,
        "12a": None, " 12 ": None, "": None, "1__0": None, "_1": None, "08": None, "1.5": None, "12345678901234567890": None, "--1": None,
        "9223372036854775807": None, "9223372036854775806": 9223372036854775806, "-9223372036854775808": -9223372036854775808, "0xFFFFFFFFFFFFFFFFF": None,
        "4294967295": None, "-1": None, "4294967294": 4294967294, "0xffffffff": None,
    }
    assert dict(zip(cases, column(spark, list(cases), "string", parse_number))) == cases
    assert column(spark, [None], "string", parse_number) == [None]


def test_numbers_that_mean_missing(spark):
    assert column(spark, [-1, 4294967295, 8589934591, 7, None], "long", known) == [None, None, None, 7, None]


def test_fixed_point(spark):
    assert column(spark, [1.239, -1.239, 0.0, None], "double", fixed_point) == [123, -123, 0, None]


def test_dates(spark):
    got = column(spark, ["2015-11-12 23:58:22", "2015-11-12", "x", "", "2015-02-30", "2015-13-01", "2015-11-12 25:00:00", "2015-11-12T01:00:00", None], "string", parse_date)
    assert got == [dt.datetime(2015, 11, 12, 23, 58, 22), dt.datetime(2015, 11, 12)] + [None] * 7
    assert column(spark, ["2015-11-12", "x"], "string", lambda c: show_value(parse_date(c), FieldType.DATE)) == ["2015-11-12 00:00:00", ""]


def test_mapping():
    m = Mapping.of("t", id="pk", name="string", age=11)
    assert m.primary_key == "id"
    assert Mapping.from_json(m.to_json()) == m
    with pytest.raises(MappingError):
        m.add("name", "number")
    with pytest.raises(MappingError):
        m.add("other", "pk")
    with pytest.raises(MappingError):
        m.drop("id")
    with pytest.raises(MappingError):
        m.kind("nothing")
    assert m.drop("name") and not m.drop("nothing")
    twice = Mapping.from_json('{"indexname": "t", "indexmapping": [{"fieldname": "c", "fieldtype": 2}, {"fieldname": "c", "fieldtype": 30}]}')
    assert twice.fields == {"c": FieldType.STRING_SEG}


def test_typed_rows(spark):
    m = Mapping.of("t", id="pk", name="string", age="number", born="date")
    raw = spark.createDataFrame([("1", "12", "x"), ("2", "zz", "y")], "id string, age string, more string")
    assert [tuple(r) for r in m.typed(raw).orderBy("id").collect()] == [("1", "", 12, None), ("2", "", None, None)]


def test_terms(spark):
    df = spark.createDataFrame([("Red-Widget red_x 2",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(analysis.tokens(F.col("s"))).collect()] == [["red", "widget", "red", "x", "2"], [], None]
    assert column(spark, ["a;b;;a", ""], "string", analysis.list_items) == [["a", "b", "", "a"], [""]]
    assert column(spark, ["abca", ""], "string", analysis.characters) == [["a", "b", "c"], []]
    assert analysis.analyzed("Red-Widget red", FieldType.STRING_SEG) == ["red", "widget"]
    assert analysis.analyzed("a;b;;a", FieldType.STRING_LIST) == ["a", "b", ""]
    assert analysis.analyzed("abca", FieldType.STRING_SINGLE) == ["a", "b", "c"]
    assert analysis.analyzed("a b", FieldType.STRING) == ["a b"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é_-1.ß", max_size=12), min_size=1, max_size=6))
def test_counting_a_term_is_as_cutting_and_counting(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(analysis.tokens(F.col("s")).alias("t"), analysis.term_count(F.col("s"), "a").alias("n"), analysis.has_term(F.col("s"), "a", FieldType.STRING_SEG).alias("h"), analysis.token_count(F.col("s")).alias("c"))
    for r in df.collect():
        assert r.n == r.t.count("a") and r.h == ("a" in r.t) and r.c == len(r.t)


def test_dictionary_tokens(spark):
    f = analysis.dictionary_tokens({"雅礼", "中学", "雅礼中学", "礼中"})
    assert column(spark, ["在雅礼中学 Abc", "", None], "string", f) == [["在", "雅礼", "礼中", "中学", "雅礼中学", "abc"], [], None]


def test_readings(spark):
    table = {"中": "zhōng,zhòng", "学": "xué", "安": "ān"}
    text = ["a中学b安", None]
    assert column(spark, text, "string", analysis.romanized(table)) == [["a", "zhong", "xue", "b", "an"], None]
    assert column(spark, text, "string", analysis.romanized(table, "tone")) == [["a", "zhōng", "xué", "b", "ān"], None]
    assert column(spark, text, "string", analysis.romanized(table, "initials")) == [["a", "zh", "x", "b", ""], None]
    assert column(spark, text, "string", analysis.romanized(table, "tone", {"中学": "zhóng,xuè"})) == [["a", "zhóng", "xuè", "b", "ān"], None]
