"""The named queries: each over whole tables, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions.analysis import dictionary_tokens, romanized
from lodeseek.functions.types import FieldType, Mapping, parse_date, parse_number
from lodeseek.operators import aggregate, filters, paging, postings, project, ranking, setops
from lodeseek.operators.aggregate import Statistic
from lodeseek.operators.filters import Filter, Op
from lodeseek.plans import search
from lodeseek.plans.request import SearchRequest, parse, parse_body
from lodeseek.sources import kv, load, shardlog
from lodeseek.sources.storage import shared_dir
from lodeseek.sources.table import Table
from lodeseek.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = Mapping.of("documents", doc_id="pk", text="string_seg", lang="gather", source="string", n_chars="number")
TAGGED = Mapping.of("tagged", doc_id="pk", tags="string_list", n="number")
EVENTS = Mapping.of("events", event_id="pk", ts="date", user_id="number", event_type="string")
PARTS = Mapping.of("parts", p_partkey="pk", p_name="string_single", p_brand="string", tags="string_list", p_size="number")


def query(sql: str | None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("_docid", F.col("doc_id"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a list field, and a number that French ones lack."""
    return docs(spark, d).select("_docid", "doc_id", F.concat_ws(";", "lang", "source").alias("tags"), F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("_docid", F.col("event_id"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumns({"_docid": F.col("p_partkey"), "tags": F.concat_ws(";", "p_type", "p_brand")})


def hits(df: DataFrame, mapping: Mapping, *terms_: tuple[str, str], where: tuple[Filter, ...] = (), **how) -> DataFrame:
    return search.hits(df, mapping, SearchRequest(terms=list(terms_), filters=list(where)), **how)


def ids(found: DataFrame, name: str = "doc_id", weight: bool = True) -> DataFrame:
    return found.select(F.col("_docid").alias(name), *(["weight"] if weight else []))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TOK = f"tok as (select doc_id, lang, source, n_chars, {_TOKENS} as t from documents)"


def _tf(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


def _w(term: str) -> str:
    return f"cast(floor({_tf(term)} / len(t)::double * 10000) as bigint)"


_TERMS = f"""terms as (select doc_id, term, count(*) as tf, any_value(n) as n from (select doc_id, len(t) as n, unnest(t) as term from tok) group by doc_id, term)"""

# -- scans, terms


@query("select doc_id, lang, source, n_chars from documents")
def scan_all(spark, d):
    return hits(docs(spark, d), DOCS).select("doc_id", "lang", "source", "n_chars")


@query("select doc_id, 0::bigint as weight from documents where source = 'src3'")
def term_exact(spark, d):
    return ids(hits(docs(spark, d), DOCS, ("source", "src3")))


@query("select doc_id from documents where list_contains(string_split(concat_ws(';', lang, source), ';'), 'src3')")
def term_list(spark, d):
    return ids(hits(tagged(spark, d), TAGGED, ("tags", "src3")), weight=False)


@query("select p_partkey from part where contains(p_name, 'w') and contains(p_name, 'g')")
def term_chars(spark, d):
    return ids(hits(parts(spark, d), PARTS, ("p_name", "wg")), "p_partkey", False)


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the')")
def term_fulltext(spark, d):
    return ids(hits(docs(spark, d), DOCS, ("text", "The")))


@query(f"with {_TOK} select doc_id from tok where list_contains(t, 'the') and list_contains(t, 'and')")
def and_terms(spark, d):
    return ids(hits(docs(spark, d), DOCS, ("text", "the and"), scored=False), weight=False)


def _scored_sql(where: str = "true", deleted: str = "false") -> str:
    return f"""
with {_TOK}, live as (select * from tok where ({where}) and not ({deleted})),
n as (select (select count(*) from tok) as m, (select count(*) from live where list_contains(t, 'and')) as d1, (select count(*) from live where list_contains(t, 'of')) as d2),
a as (select doc_id, {_w('the')} as w0, m, d1, d2 from live, n where list_contains(t, 'the') and list_contains(t, 'and') and list_contains(t, 'of')),
b as (select *, w0 + cast(floor(w0 * log10(m / d1::double)) as bigint) as w1 from a)
select doc_id, w1 + cast(floor(w1 * log10(m / d2::double)) as bigint) as weight from b"""


@query(_scored_sql())
def and_terms_scored(spark, d):
    return ids(hits(docs(spark, d), DOCS, ("text", "the and of")))


@query(_scored_sql("n_chars >= 300", "lang = 'de'"))
def and_terms_scored_filtered(spark, d):
    df = docs(spark, d)
    return ids(hits(df, DOCS, ("text", "the and of"), where=(Filter("n_chars", Op.OVER, 300),), deleted=df.where("lang = 'de'")))


@query(f"""with {_TOK}, {_TERMS} select doc_id, max(cast(floor(tf / n::double * 10000) as bigint)) as weight from terms where term in ('de', 'la') group by doc_id""")
def or_terms(spark, d):
    df = docs(spark, d)
    return ids(setops.union(*[hits(df, DOCS, ("text", t)).select("_docid", "weight") for t in ("de", "la")]))


@query("select p_partkey from part where contains(p_name, 'r') and contains(p_name, 'd') and p_type = 'ECONOMY' and p_brand = 'Brand#17'")
def query_by_field_type(spark, d):
    return ids(hits(parts(spark, d), PARTS, ("p_name", "rd"), ("tags", "ECONOMY;Brand#17"), ("p_brand", "Brand#17")), "p_partkey", False)


@query("select event_id from events where event_type = 'click' and user_id in (1, 2, 3, 5, 8) and ts >= '2024-01-10'")
def query_parameters(spark, d):
    request = parse({"index": "events", "ps": "10", "pg": "1", "event_type": "click", "-user_id": "1,2,3,5,0x8", ">ts": "2024-01-10"}, EVENTS)
    return ids(search.hits(events(spark, d), EVENTS, request), "event_id", False)


@query("select doc_id from documents where doc_id % 4 = 2 and lang = 'de'")
def search_shard(spark, d):
    """Only one shard of four, as the request forces it."""
    request = parse({"ps": "10", "pg": "1", "_force": "1", "_shard": "2", "lang": "de"}, DOCS)
    df = docs(spark, d).withColumn("_shard", shardlog.shard_of(F.col("doc_id"), 4))
    return ids(search.hits(df, DOCS, request), weight=False)


# -- filters


def _filter(name: str, source, mapping: Mapping, f: Filter, key: str, sql: str) -> None:
    def run(spark, d):
        return hits(source(spark, d), mapping, where=(f,)).select(key)

    run.__name__ = name
    query(sql)(run)


_N = "select doc_id from (select doc_id, case when lang <> 'fr' then n_chars end as n from documents) where"
_filter("filter_eq", events, EVENTS, Filter("user_id", Op.EQ, 8), "event_id", "select event_id from events where user_id = 8")
_filter("filter_in", events, EVENTS, Filter("user_id", Op.EQ, values=(3, 5, 8)), "event_id", "select event_id from events where user_id in (3, 5, 8)")
_filter("filter_not", tagged, TAGGED, Filter("n", Op.NOT, 500), "doc_id", f"{_N} n <> 500")
_filter("filter_not_in", tagged, TAGGED, Filter("n", Op.NOT, values=(500, 501, 502)), "doc_id", f"{_N} coalesce(n not in (500, 501, 502), true)")
_filter("filter_over", tagged, TAGGED, Filter("n", Op.OVER, 500), "doc_id", f"{_N} n >= 500")
_filter("filter_over_strict", tagged, TAGGED, Filter("n", Op.OVER, 500, strict=True), "doc_id", f"{_N} n > 500")
_filter("filter_less", tagged, TAGGED, Filter("n", Op.LESS, 500), "doc_id", f"{_N} n <= 500")
_filter("filter_range", tagged, TAGGED, Filter("n", Op.RANGE, 500, 900), "doc_id", f"{_N} n between 500 and 900")
_filter("filter_date_range", events, EVENTS, Filter("ts", Op.RANGE, "2024-01-05", "2024-01-10 12:00:00"), "event_id", "select event_id from events where ts between '2024-01-05' and '2024-01-10 12:00:00'")
_filter("filter_date_over", events, EVENTS, Filter("ts", Op.OVER, "2024-01-20"), "event_id", "select event_id from events where ts >= '2024-01-20'")
_filter("filter_date_less", events, EVENTS, Filter("ts", Op.LESS, "2024-01-03"), "event_id", "select event_id from events where ts <= '2024-01-03'")


@query("select 0::bigint as matched, count(*) as total from part")
def filter_other_type(spark, d):
    """A filter that its field's type hasn't matches nothing."""
    df = parts(spark, d)
    found = hits(df, PARTS, where=(Filter("p_brand", Op.STR_PREFIX, values=("Brand",)),)).agg(F.count("*").alias("matched"))
    return found.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


_filter("str_prefix", parts, PARTS, Filter("p_name", Op.STR_PREFIX, values=("blue", "red")), "p_partkey", "select p_partkey from part where starts_with(p_name, 'blue') or starts_with(p_name, 'red')")
_filter("str_suffix", parts, PARTS, Filter("p_name", Op.STR_SUFFIX, values=("ring", "widget")), "p_partkey", "select p_partkey from part where suffix(p_name, 'ring') or suffix(p_name, 'widget')")
_filter("str_contains_all", parts, PARTS, Filter("p_name", Op.STR_CONTAINS_ALL, values=("red", "get")), "p_partkey", "select p_partkey from part where contains(p_name, 'red') and contains(p_name, 'get')")
_filter("str_equals_any", parts, PARTS, Filter("p_name", Op.STR_EQUALS_ANY, values=("red widget", "small ring")), "p_partkey", "select p_partkey from part where p_name in ('red widget', 'small ring')")


@query(r"""with raw as (select o_orderkey, case o_orderstatus when 'O' then o_orderkey::varchar when 'F' then '0x' || hex(o_orderkey) else ' ' || o_orderkey end as s from orders)
select o_orderkey, s, case when s like ' %' or o_orderkey & 4294967295 = 4294967295 then null else o_orderkey end as number from raw""")
def number_parse(spark, d):
    key = F.col("o_orderkey")
    s = F.when(F.col("o_orderstatus") == "O", key.cast("string")).when(F.col("o_orderstatus") == "F", F.concat(F.lit("0x"), F.hex(key))).otherwise(F.concat(F.lit(" "), key))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).withColumn("number", parse_number(F.col("s")))


@query("""select o_orderkey, case o_orderstatus when 'O' then o_orderdate::date::timestamp when 'F' then date_trunc('second', o_orderdate) + interval 1 hour end as day from orders""")
def date_parse(spark, d):
    at, kind = F.col("o_orderdate"), F.col("o_orderstatus")
    s = F.when(kind == "O", F.date_format(at, "yyyy-MM-dd")).when(kind == "F", F.date_format(at + F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "dd.MM.yyyy"))
    return table(spark, d, "orders").select("o_orderkey", parse_date(s).alias("day"))


# -- index


@query(f"""with {_TOK}, {_TERMS} select 'text' as field, term, doc_id, cast(floor(tf / n::double * 10000) as bigint) as weight from terms
union all select 'lang', lang, doc_id, 0 from documents union all select 'source', source, doc_id, 0 from documents""")
def build_postings(spark, d):
    return postings.postings(docs(spark, d), DOCS).withColumnRenamed("_docid", "doc_id")


@query(f"with {_TOK}, {_TERMS} select doc_id, term, tf, n from terms")
def term_freq(spark, d):
    return postings.term_frequencies(docs(spark, d), "doc_id", "text").withColumnRenamed("_docid", "doc_id")


@query(f"with {_TOK}, {_TERMS} select doc_id, term, cast(floor(tf / n::double * 10000) as bigint) as weight from terms")
def tf_weight(spark, d):
    found = postings.term_frequencies(docs(spark, d), "doc_id", "text")
    return found.select(F.col("_docid").alias("doc_id"), "term", postings.tf_weight(F.col("tf"), F.col("n")).alias("weight"))


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') order by doc_id limit 1 offset 5")
def posting_nth(spark, d):
    found = postings.field_postings(docs(spark, d), "doc_id", "text", FieldType.STRING_SEG)
    return postings.nth(found, "the", 5).select(F.col("_docid").alias("doc_id"), "weight")


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') and doc_id = 7")
def posting_lookup(spark, d):
    found = postings.field_postings(docs(spark, d), "doc_id", "text", FieldType.STRING_SEG)
    return postings.posting_of(found, "the", 7).withColumnRenamed("_docid", "doc_id")


@query("select source as term, count(*) as df, lead(source) over (order by source) as following from documents group by source")
def dictionary_terms(spark, d):
    """The terms of a facet field in order, each with the one after it: such fields have few terms."""
    found = postings.doc_frequencies(postings.field_postings(docs(spark, d), "doc_id", "source", FieldType.STRING))
    return found.select("term", "df", F.lead("term").over(Window.partitionBy("field").orderBy("term")).alias("following"))


@query(f"with {_TOK}, {_TERMS} select 'text' as field, term, count(*) as df from terms group by term")
def doc_freq(spark, d):
    return postings.term_documents(docs(spark, d), "text")


@query("select doc_id, c as term from (select doc_id, unnest(list_distinct(string_split(source, ''))) as c from documents)")
def character_terms(spark, d):
    return postings.field_postings(docs(spark, d), "doc_id", "source", FieldType.STRING_SINGLE).select(F.col("_docid").alias("doc_id"), "term")


@query("select p_partkey, 0::bigint as weight from part where p_type = 'ECONOMY' or p_brand = 'ECONOMY'")
def keyword_search(spark, d):
    found = postings.keyword_postings(table(spark, d, "part").withColumn("words", F.array("p_brand", "p_type")), "p_partkey", "words")
    return ids(postings.lookup(found, "words", "ECONOMY"), "p_partkey")


def _weighted(spark, d) -> DataFrame:
    df = docs(spark, d)
    n = df.agg(F.count("*").alias("m"))
    found = hits(df, DOCS, ("text", "the")).select("_docid", "weight")
    # one row of two counts
    return found.crossJoin(F.broadcast(n.crossJoin(found.agg(F.count("*").alias("df")))))


_WEIGHTED = f"with {_TOK}, the as (select doc_id, {_w('the')} as w from tok where list_contains(t, 'the')), n as (select (select count(*) from documents) as m, (select count(*) from the) as df)"


@query(f"{_WEIGHTED} select doc_id, cast(floor(w * log10(m / df::double)) as bigint) as weight from the, n")
def idf_weight(spark, d):
    return _weighted(spark, d).select(F.col("_docid").alias("doc_id"), ranking.idf_scaled(F.col("weight"), F.col("m"), F.col("df")).alias("weight"))


@query(f"{_WEIGHTED} select doc_id, cast(floor(w / 10000.0::double * log10(m / df::double) * 1000) as bigint) as weight from the, n")
def tfidf(spark, d):
    return _weighted(spark, d).select(F.col("_docid").alias("doc_id"), ranking.tf_idf(F.col("weight"), F.col("m"), F.col("df")).alias("weight"))


def _stored(spark, d, batches: tuple[str, ...] = ("true",)) -> Table:
    """The documents as a table, a segment for each condition."""
    t = Table.create(spark, shared_dir(spark, "table-"), DOCS)
    for where in batches:
        t.add(DOCS.typed(table(spark, d, "documents").where(where)))
    return t


_SEGMENTS = ("lang = 'en'", "lang in ('de', 'es')", "coalesce(lang, '') not in ('en', 'de', 'es')")


def _by_key(t: Table, found: DataFrame, weight: bool = True) -> DataFrame:
    own = t.everything().select("_docid", F.col("doc_id").cast("bigint").alias("doc_id"))
    return found.join(own, "_docid").select("doc_id", *(["weight"] if weight else []))


@query(_scored_sql("n_chars >= 300", "lang = 'de'"))
def index_scored(spark, d):
    t = _stored(spark, d, _SEGMENTS)
    found = t.build_index()
    t.delete(t.rows().where("lang = 'de'").select("doc_id"))
    request = SearchRequest(terms=[("text", "the and of")], filters=[Filter("n_chars", Op.OVER, 300)])
    return _by_key(t, search.index_hits(found, t.mapping(), request, t.max_doc(), t.everything(), t.tombstones()))


@query(f"with {_TOK}, {_TERMS} select term, count(*) as df, min(doc_id) as first, max(doc_id) as last from terms group by term")
def merge_postings(spark, d):
    df = docs(spark, d)
    segments = [postings.field_postings(df.where(w), "doc_id", "text", FieldType.STRING_SEG) for w in _SEGMENTS]
    return postings.merged(*segments).groupBy("term").agg(F.count("*").alias("df"), F.min("_docid").alias("first"), F.max("_docid").alias("last"))


# -- sets


def _lists(spark, d, *words: str) -> list[DataFrame]:
    df = docs(spark, d)
    return [hits(df, DOCS, ("text", w)).select("_docid", "weight") for w in words]


@query(f"with {_TOK} select doc_id, {_w('de')} as weight from tok where list_contains(t, 'de') and list_contains(t, 'la')")
def set_intersection(spark, d):
    return ids(setops.intersection(*_lists(spark, d, "de", "la")))


@query(f"with {_TOK}, {_TERMS} select distinct doc_id, cast(floor(tf / n::double * 10000) as bigint) as weight from terms where term in ('de', 'la')")
def set_union(spark, d):
    return ids(setops.union_of_postings(*_lists(spark, d, "de", "la")))


@query(f"with {_TOK} select doc_id, {_w('de')} as weight from tok where list_contains(t, 'de') and not list_contains(t, 'la')")
def set_difference(spark, d):
    return ids(setops.difference(*_lists(spark, d, "de", "la")))


# -- order, pages, columns


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') order by weight desc, doc_id")
def sort_weight(spark, d):
    return ranking.by_weight(ids(hits(docs(spark, d), DOCS, ("text", "the"))), "doc_id")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id")
def sort_field(spark, d):
    return ranking.by_field(docs(spark, d), "n_chars", True).select("doc_id", "n_chars")


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') order by weight desc, doc_id limit 10")
def page_default(spark, d):
    return paging.page(ranking.by_weight(ids(hits(docs(spark, d), DOCS, ("text", "the"))), "doc_id"), "x", "7")


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') order by weight desc, doc_id limit 25 offset 150")
def page_deep(spark, d):
    return paging.page(ranking.by_weight(ids(hits(docs(spark, d), DOCS, ("text", "the"))), "doc_id"), 25, 7)


@query(f"with {_TOK} select count(*) as total from tok where list_contains(t, 'the')")
def total_count(spark, d):
    return hits(docs(spark, d), DOCS, ("text", "the"), scored=False).agg(F.count("*").alias("total"))


@query("select doc_id::varchar as doc_id, lang, '' as nothing, n_chars::varchar as n_chars from documents")
def show_fields(spark, d):
    return project.show(docs(spark, d), DOCS, ["doc_id", "lang", "nothing", "n_chars"])


@query("select doc_id as _docid, text, lang, source, n_chars::varchar as n_chars from documents where doc_id = 7")
def get_document(spark, d):
    return project.get_document(docs(spark, d), DOCS, 7)


@query("select doc_id as _docid, source, '' as nothing from documents where doc_id = 7")
def get_fields(spark, d):
    return project.get_fields(docs(spark, d), DOCS, 7, ["source", "nothing"])


@query("select doc_id::varchar as doc_id, lang, source from documents where doc_id = 7")
def pk_lookup(spark, d):
    t = _stored(spark, d)
    return project.by_key(t.rows(), t.mapping(), "7").select("doc_id", "lang", "source")


@query("select o_orderkey, c_name as customer, n_name as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def enrich(spark, d):
    orders = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    own = project.enriched(orders, table(spark, d, "customer"), ["c_custkey"], {"c_name": "customer", "c_nationkey": "n_nationkey"})
    return project.enriched(own, table(spark, d, "nation"), ["n_nationkey"], {"n_name": "nation"}).select("o_orderkey", "customer", "nation")


# -- facets, statistics


@query(f"with {_TOK} select lang, count(*) as n from tok where list_contains(t, 'the') group by lang")
def gather_one(spark, d):
    return aggregate.gather(hits(docs(spark, d), DOCS, ("text", "the"), scored=False), "lang")


@query(f"with {_TOK}, h as (select * from tok where list_contains(t, 'the')) select 'lang' as field, lang as value, count(*) as n from h group by lang union all select 'source', source, count(*) from h group by source")
def gather_many(spark, d):
    return aggregate.gather_many(hits(docs(spark, d), DOCS, ("text", "the"), scored=False), ["lang", "source"])


def _stat(name: str, s: Statistic, sql: str) -> None:
    def run(spark, d):
        return aggregate.statistics(hits(events(spark, d), EVENTS), s)

    run.__name__ = name
    query(f"select event_type, {sql} as value from events group by event_type")(run)


_stat("stat_count", Statistic("count", None, "event_type"), "count(*)")
_stat("stat_sum", Statistic("sum", "user_id", "event_type"), "sum(user_id)::bigint")
_stat("stat_avg", Statistic("avg", "user_id", "event_type"), "avg(user_id)")
_stat("stat_avg_int", Statistic("avg_int", "user_id", "event_type"), "floor(avg(user_id))::bigint")
_stat("stat_max", Statistic("max", "user_id", "event_type"), "max(user_id)")
_stat("stat_min", Statistic("min", "user_id", "event_type"), "min(user_id)")


@query("select o_custkey, max(o_orderkey) as value from orders group by o_custkey having max(o_orderkey) between 1000 and 12000")
def stat_having(spark, d):
    return aggregate.statistics(table(spark, d, "orders"), Statistic("max", "o_orderkey", "o_custkey", Op.RANGE, 1000, 12000))


@query("select (select count(distinct event_type) from events) as result_count, event_type as k, count(*) as v from events group by event_type")
def stat_result(spark, d):
    found = aggregate.statistics_map(events(spark, d), Statistic("count", None, "event_type"))
    return found.select("result_count", F.explode("result").alias("k", "v"))


@query("select l_returnflag, l_linestatus, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as value, count(*) as n from lineitem where l_shipdate <= '2001-01-01' group by all")
def stat_volume(spark, d):
    rows = filters.matching(table(spark, d, "lineitem"), [Filter("l_shipdate", Op.LESS, "2001-01-01")], Mapping.of("lines", l_shipdate="date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("value"), F.count("*").alias("n"))


@query("select count(*) as n, string_agg(event_id::varchar, ',' order by event_id) as ids from events where user_id = 8")
def contact_list(spark, d):
    found = aggregate.contacts(hits(events(spark, d), EVENTS, where=(Filter("user_id", Op.EQ, 8),)), "event_id")
    return found.select("n", F.array_join("ids", ",").alias("ids"))


@query("select count(*) > 0 as has_contact, coalesce(bool_or(event_type = 'error'), false) as matches from events where user_id = 8")
def contact_flags(spark, d):
    return aggregate.contact_flags(events(spark, d), "user_id", 8, F.col("event_type") == "error")


# -- changes


def _state(t: Table) -> DataFrame:
    return t.rows().select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "n_chars")


@query("select doc_id, lang, case when lang = 'de' then 'changed' else source end as source, case when lang = 'de' then n_chars + 1 else n_chars end as n_chars from documents")
def upsert_latest(spark, d):
    t = _stored(spark, d)
    own = DOCS.typed(table(spark, d, "documents").where("lang = 'de'")).withColumns({"source": F.lit("changed"), "n_chars": F.col("n_chars") + 1})
    # each key is there twice: the larger number counts
    t.upsert(own.unionByName(own.withColumn("n_chars", F.lit(-2).cast("bigint"))), order_by="n_chars")
    return _state(t)


@query("select doc_id, lang, source, n_chars from documents where lang <> 'de'")
def delete_pk(spark, d):
    t = _stored(spark, d, _SEGMENTS)
    t.delete(t.rows().where("lang = 'de'").select("doc_id"))
    return _state(t)


@query("select count(*) as rows, count(*) filter (lang = 'de') as deleted from documents")
def tombstones(spark, d):
    t = _stored(spark, d)
    t.delete(t.rows().where("lang = 'de'").select("doc_id"))
    return t.everything().agg(F.count("*").alias("rows")).crossJoin(t.tombstones().agg(F.count("*").alias("deleted")))


@query("select doc_id, lang, source, n_chars, case when lang = 'de' then 'new' else '' end as note, case when lang = 'de' then 5 end as stars from documents")
def add_field(spark, d):
    t = _stored(spark, d, ("coalesce(lang, '') <> 'de'",))
    t.add_field("note", "string")
    t.add_field("stars", "number")
    t.add(DOCS.typed(table(spark, d, "documents").where("lang = 'de'")).withColumns({"note": F.lit("new"), "stars": F.lit(5)}))
    return t.rows().select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "n_chars", "note", "stars").withColumn("stars", F.col("stars").cast("int"))


@query("select doc_id::varchar as doc_id, text, lang, n_chars from documents")
def drop_field(spark, d):
    t = _stored(spark, d)
    t.drop_field("source")
    return t.rows().drop("_docid")


@query("select doc_id, lang, source, n_chars from documents where lang <> 'es'")
def merge_segments(spark, d):
    t = _stored(spark, d, _SEGMENTS)
    t.delete(t.rows().where("lang = 'es'").select("doc_id"))
    t.merge()
    return _state(t)


@query("select doc_id, lang, source, n_chars from documents")
def segment_union(spark, d):
    return _state(_stored(spark, d, _SEGMENTS))


# -- loading


@query("select o_orderkey::varchar as id, o_orderstatus as status, o_custkey as customer, date_trunc('day', o_orderdate) as day from orders")
def load_delimited(spark, d):
    mapping = Mapping.of("orders", id="pk", status="string", customer="number", day="date")
    path = shared_dir(spark, "load-")
    lines = table(spark, d, "orders").select(F.concat_ws("\t", "o_orderkey", "o_orderstatus", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value"))
    lines.unionByName(lines.select(F.concat(F.substring("value", 1, 3), F.lit("|bad")).alias("value"))).write.text(path)
    return mapping.typed(load.delimited(spark, path, list(mapping.fields)))


@query("select event_id::varchar as event_id, date_trunc('second', ts) as ts, user_id, event_type from events")
def load_jsonl(spark, d):
    path = shared_dir(spark, "load-")
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("value").alias("extra"))).alias("value"))
    lines.unionByName(lines.select(F.substring("value", 1, 9).alias("value"))).write.text(path)
    return EVENTS.typed(load.json_lines(spark, path, EVENTS))


@query("select event_id, (user_id % 4)::int as shard from events")
def shard_assign(spark, d):
    return table(spark, d, "events").select("event_id", shardlog.shard_of(F.col("user_id"), 4).alias("shard"))


@query("""with r as (select (user_id % 4)::int as shard, event_id, row_number() over (partition by user_id % 4 order by event_id) - 1 as "offset" from events)
select shard, "offset", event_id from r where shard = 2 and "offset" between 100 and 349""")
def pull_offset(spark, d):
    path = shared_dir(spark, "log-")
    shardlog.append(spark, path, table(spark, d, "events").select("event_id", "user_id"), 4, "user_id", "event_id")
    return shardlog.pull(shardlog.read(spark, path), 2, 100, 250).select("shard", "offset", F.get_json_object("body", "$.event_id").cast("bigint").alias("event_id"))


@query("select event_id, date_trunc('second', ts) as ts, user_id, event_type from events")
def stream_ingest(spark, d):
    log, t = shared_dir(spark, "log-"), Table.create(spark, shared_dir(spark, "table-"), EVENTS)
    rows = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type")
    shardlog.append(spark, log, rows, 4, "user_id", "event_id")
    ingest.ingest(ingest.log_stream(spark, log, 2), t, shared_dir(spark, "stream-")).awaitTermination()
    return t.rows().select(F.col("event_id").cast("bigint").alias("event_id"), "ts", "user_id", "event_type")


@query("""select row_number() over (order by ts, event_type) - 1 as "LogId", epoch(date_trunc('second', ts))::bigint as "LogTimestamp", event_type as detail from events""")
def binlog_append(spark, d):
    found = ingest.binlog(table(spark, d, "events").select("ts", F.col("event_type").alias("detail")))
    return found.select("LogId", "LogTimestamp", F.col("LogDetail").cast("string").alias("detail"))


# -- keys and values


def pairs(spark, d) -> DataFrame:
    """Customers by market segment as buckets of one store."""
    return table(spark, d, "customer").select(F.concat(F.lit("customer/"), F.lower("c_mktsegment")).alias("bucket"), F.col("c_name").cast("binary").alias("key"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").cast("binary").alias("value"))


_KV = "with kv as (select 'customer/' || lower(c_mktsegment) as bucket, c_name as key, c_acctbal::decimal(12,2)::varchar as value from customer)"
_ONE = "customer/household"


def texts(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.col(c).cast("string") for c, t in found.dtypes if t == "binary"})


def _kv(name: str, f, sql: str) -> None:
    def run(spark, d):
        return texts(f(pairs(spark, d)))

    run.__name__ = name
    query(f"{_KV} {sql}")(run)


_kv("kv_get", lambda v: kv.get(v, _ONE, "Customer#000000000"), f"select * from kv where bucket = '{_ONE}' and key = 'Customer#000000000'")
_kv("kv_scan", lambda v: kv.scan(v, _ONE), f"select * from kv where bucket = '{_ONE}'")
_kv("kv_nested", lambda v: kv.in_bucket(v, "customer", nested=True), "select * from kv")
_kv("kv_prefix", lambda v: kv.prefix(v, _ONE, "Customer#0000001"), f"select * from kv where bucket = '{_ONE}' and starts_with(key, 'Customer#0000001')")
_kv("kv_range", lambda v: kv.between(v, _ONE, "Customer#000000010", "Customer#000000100"), f"select * from kv where bucket = '{_ONE}' and key between 'Customer#000000010' and 'Customer#000000100'")
_kv("kv_seek", lambda v: kv.seek(v, _ONE, "Customer#00000005"), f"select * from kv where bucket = '{_ONE}' and key >= 'Customer#00000005' order by key limit 1")
_kv("kv_next", lambda v: kv.after(v, _ONE, "Customer#000000000"), f"select * from kv where bucket = '{_ONE}' and key > 'Customer#000000000' order by key limit 1")
_kv("kv_prev", lambda v: kv.before(v, _ONE, "Customer#00000005"), f"select * from kv where bucket = '{_ONE}' and key < 'Customer#00000005' order by key desc limit 1")
_kv("kv_first_last", kv.first_last, "select bucket, min(key) as first, max(key) as last from kv group by bucket")
_kv("kv_next_prev", kv.neighbours, "select *, lag(key) over w as previous, lead(key) over w as next from kv window w as (partition by bucket order by key)")
_kv("kv_bucket_stats", kv.statistics, "select bucket, count(*) as keys, sum(strlen(key))::bigint as key_bytes, sum(strlen(value))::bigint as value_bytes from kv group by bucket")
_kv("kv_totals", kv.totals, "select count(distinct bucket) as buckets, count(*) as pairs from kv")
_kv("kv_check", lambda v: kv.problems(v.unionByName(v.where(f"bucket = '{_ONE}'"))), f"select bucket, key, 2::bigint as n, strlen(value)::int as v from kv where bucket = '{_ONE}'")
_kv("kv_has", lambda v: v.sparkSession.createDataFrame([(k, kv.has(v, _ONE, k)) for k in ("Customer#000000005", "nobody")], "name string, there boolean"), f"select n as name, exists(select 1 from kv where bucket = '{_ONE}' and key = n) as there from (values ('Customer#000000005'), ('nobody')) t(n)")
_kv("kv_sequence", lambda v: kv.sequenced(v, "bucket", "key", 10).select("bucket", "key", "seq"), "select bucket, key, row_number() over (partition by bucket order by key) + 10 as seq from kv")


@query(f"{_KV} select bucket, key, case when key >= 'Customer#0000001' then value || '!' else value end as value from kv where not starts_with(key, 'Customer#00000001') and bucket <> 'customer/machinery'")
def kv_transactions(spark, d):
    """Two commits and a rollback: batch puts, deletes and a dropped bucket."""
    view = pairs(spark, d)
    store = kv.Store(spark, shared_dir(spark, "kv-"))
    names = sorted(r.bucket for r in view.select("bucket").distinct().collect())
    with store.update() as tx:
        tx.create_bucket("customer")
        for b in names:
            tx.create_bucket(b)
            tx.put_all(b, kv.in_bucket(view, b))
    with store.update() as tx:
        for b in names:
            tx.put_all(b, kv.in_bucket(view, b).where(F.col("key").cast("string") >= "Customer#0000001").select("key", F.concat(F.col("value").cast("string"), F.lit("!")).alias("value")))
        tx.delete_all(view.where(F.col("key").cast("string").startswith("Customer#00000001")))
        tx.delete_bucket("customer/machinery")
    tx = store.update()
    tx.put(names[0], "lost", "value")
    tx.rollback()
    return texts(store.view())


# -- the whole of it


@query(f"""with {_TOK}, h as (select * from tok where list_contains(t, 'the') and n_chars between 200 and 5000) select (select count(*) from h) as total, lang as value, count(*) as n from h group by lang""")
def worked_example(spark, d):
    """A full-text term, a range, a facet and the total."""
    request = SearchRequest(terms=[("text", "the")], filters=[Filter("n_chars", Op.RANGE, 200, 5000)], gather=["lang"])
    found = search.hits(docs(spark, d), DOCS, request)
    by = search.facets(found, request).select("value", "n")
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total"))))


@query(f"""with {_TOK} select doc_id::varchar as doc_id, {_w('the')} as weight, lang, n_chars::varchar as n_chars from tok where list_contains(t, 'the') and n_chars between 200 and 5000 order by weight desc, tok.doc_id limit 10""")
def worked_example_page(spark, d):
    request = SearchRequest(terms=[("text", "the")], filters=[Filter("n_chars", Op.RANGE, 200, 5000)], show=["doc_id", "lang", "n_chars"])
    df = docs(spark, d)
    return search.page(search.hits(df, DOCS, request), DOCS, request).drop("_docid")


_PAGE = f"""with {_TOK}, h as (select *, {_w('the')} as weight from tok where list_contains(t, 'the') and n_chars between 200 and 5000),
g as (select string_agg(lang || '=' || n, ',' order by lang) as gather from (select lang, count(*) as n from h group by lang)), c as (select count(*) as total from h)"""


def _answer(found: DataFrame) -> DataFrame:
    """A JSON answer as rows: the page's documents in their order, each with what holds for the whole."""
    kind = "struct<totalCount:bigint,`from`:bigint,`to`:bigint,status:string,gather:struct<lang:array<struct<value:string,n:bigint>>>,dataDetail:array<struct<doc_id:string,lang:string,n_chars:string>>>"
    x = found.select(F.from_json("json", kind).alias("x")).select("x.*")
    by = F.array_join(F.transform("gather.lang", lambda v: F.concat_ws("=", v["value"], v["n"].cast("string"))), ",")
    return x.select(F.col("totalCount").alias("total"), F.col("from").alias("first"), F.col("to").alias("last"), "status", by.alias("gather"), F.posexplode("dataDetail").alias("place", "doc")).select("total", "first", "last", "status", "gather", "place", "doc.*")


@query(f"""{_PAGE} select total, 11::bigint as first, least(total, 20)::bigint as last, 'OK' as status, gather, (row_number() over (order by weight desc, doc_id) - 11)::int as place, doc_id::varchar as doc_id, lang, n_chars::varchar as n_chars
from h, g, c qualify row_number() over (order by weight desc, doc_id) between 11 and 20""")
def search_response(spark, d):
    """The second page as one JSON answer."""
    request = SearchRequest(terms=[("text", "the")], filters=[Filter("n_chars", Op.RANGE, 200, 5000)], gather=["lang"], show=["doc_id", "lang", "n_chars"], page=2)
    return _answer(search.response(search.hits(docs(spark, d), DOCS, request), DOCS, request))


_BODY = """{"search": [{"field": "text", "query": "the"}], "filters": [{"field": "n_chars", "op": "range", "start": 200, "end": 5000}], "gather": ["lang"], "show": ["doc_id", "lang", "n_chars"],
"sort": {"by": "n_chars", "descending": true}, "pageSize": 5, "statistics": [{"op": "sum", "field": "n_chars", "gather": "lang"}, {"op": "max", "field": "n_chars"}]}"""


@query(f"""{_PAGE} select total, gather, (row_number() over (order by n_chars desc, doc_id) - 1)::int as place, doc_id::varchar as doc_id, lang, (select max(n_chars) from h)::bigint as most,
(select sum(n_chars) from h where lang = 'en')::bigint as english from h, g, c qualify row_number() over (order by n_chars desc, doc_id) <= 5""")
def request_body(spark, d):
    """A request as one JSON body: terms, a filter, a facet, statistics, and the order of a field."""
    request = parse_body(_BODY, DOCS)
    found = search.response(search.hits(docs(spark, d), DOCS, request), DOCS, request)
    stats = found.select(F.get_json_object("json", "$.statistics.value_0.en").cast("bigint").alias("english"), F.get_json_object("json", "$.statistics.value_1").cast("bigint").alias("most"))
    return _answer(found).select("total", "gather", "place", "doc_id", "lang").crossJoin(F.broadcast(stats))


@query("select doc_id, n_chars from documents where lang = 'de' order by doc_id limit 10")
def sort_id(spark, d):
    request = parse({"ps": "10", "pg": "1", "lang": "de", "sort": "false"}, DOCS)
    return search.page(search.hits(docs(spark, d), DOCS, request), DOCS, request).select(F.col("_docid").alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"))


@query("select doc_id, n_chars from documents where lang = 'de' order by n_chars desc, doc_id limit 10 offset 10")
def sort_request(spark, d):
    request = parse({"ps": "10", "pg": "2", "lang": "de", "sort": "n_chars:desc"}, DOCS)
    return search.page(search.hits(docs(spark, d), DOCS, request), DOCS, request).select(F.col("_docid").alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"))


@query(f"with {_TOK} select doc_id, {_w('the')} as weight from tok where list_contains(t, 'the') order by weight desc, doc_id limit 10 offset 20")
def search_shards(spark, d):
    """A page merged from the best rows of four shards."""
    request = SearchRequest(terms=[("text", "the")], page=3)
    df = docs(spark, d).withColumn("_shard", shardlog.shard_of(F.col("doc_id"), 4))
    return ids(search.over_shards(df, DOCS, request, 4))


# -- other ways in


@query("select doc_id, lang, case when doc_id = 7 then 'pushed' else source end as source, case when doc_id = 7 then 16 else n_chars end as n_chars from documents")
def push_document(spark, d):
    t = _stored(spark, d)
    own = table(spark, d, "documents").where("doc_id = 7").first()
    load.push(t, {"doc_id": "7", "text": own.text, "lang": own.lang, "source": "pushed", "n_chars": "0x10", "unknown": "x"})
    return _state(t)


@query("select doc_id, lang, source, n_chars from documents where lang = 'de'")
def load_and_destroy(spark, d):
    """A table that is loaded with a merge, copied out, and destroyed."""
    t = Table.create(spark, shared_dir(spark, "table-"), DOCS)
    for where in ("lang = 'de' and doc_id % 2 = 0", "lang = 'de' and doc_id % 2 = 1"):
        load.load(t, table(spark, d, "documents").where(where).select(*[F.col(f).cast("string").alias(f) for f in DOCS.fields]), merge=True)
    kept = shared_dir(spark, "copy-")
    _state(t).write.parquet(kept)
    t.destroy()
    return spark.read.parquet(kept)


@query("select p_partkey, 'ECON' as first, true as econ from part where p_type = 'ECONOMY'")
def dictionary_cut(spark, d):
    """Texts cut by a dictionary that has a word, and a shorter one within it."""
    cut = dictionary_tokens({"economy", "econ"})
    found = table(spark, d, "part").where("p_type = 'ECONOMY'").withColumn("t", cut("p_type"))
    return found.select("p_partkey", F.upper(F.element_at("t", 1)).alias("first"), (F.element_at("t", 2) == "economy").alias("econ"))


@query("select n_nationkey, list_transform(list_filter(string_split(lower(n_name), ''), lambda c: c in ('a', 'e')), lambda c: case c when 'a' then 'ah' else 'eh' end) as readings from nation")
def readings(spark, d):
    """Readings of characters by a table, without tones; what has none is left out."""
    read = romanized({"a": "āh,a", "e": "ēh"})
    found = table(spark, d, "nation").withColumn("r", read(F.lower("n_name")))
    return found.select("n_nationkey", F.filter("r", lambda x: x.isin("ah", "eh")).alias("readings"))


@query(f"{_KV} select bucket, key, value from kv where bucket = '{_ONE}' union all select '{_ONE}', 'object', '{{\"a\": [1, 2]}}' union all select '{_ONE}', 'one', '1' union all select '{_ONE}', 'two', '2'")
def kv_backup(spark, d):
    """A store with a JSON value and two batched puts, read from its backup. A hook counts the commits."""
    store, seen = kv.Store(spark, shared_dir(spark, "kv-")), []
    with store.update() as tx:
        tx.on_commit(lambda: seen.append(1))
        for b in ("customer", _ONE):
            tx.create_bucket(b)
        tx.put_all(_ONE, kv.in_bucket(pairs(spark, d), _ONE))
        tx.put_json(_ONE, "object", {"a": [1, 2]})
    for k, v in (("one", "1"), ("two", "2")):
        store.batch(lambda tx, k=k, v=v: tx.put(_ONE, k, v))
    store.flush()
    copy = shared_dir(spark, "kv-")
    store.backup(copy)
    if seen != [1]:
        raise RuntimeError("the hook wasn't called once")
    return texts(kv.Store(spark, copy).view())
