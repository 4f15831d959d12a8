"""From a request to hits, pages and answers.

There are two ways to the same hits. Without an index each term is a condition on the text itself, so a query
is one scan (two if it ranks by several terms, whose document frequencies come first). With stored postings the
terms' lists are read from their partitions and joined, and only then the columns that filters need.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.analysis import analyzed, has_term, term_count, token_count
from lodeseek.functions.types import FieldType, Mapping
from lodeseek.operators import aggregate, paging, project, ranking
from lodeseek.operators.filters import matching
from lodeseek.operators.postings import BUCKETS, lookup, tf_weight
from lodeseek.plans.request import SearchRequest


def query_terms(request: SearchRequest, mapping: Mapping) -> list[tuple[str, str]] | None:
    """All (field, term) of the request in their order, each once; None if a value has no term, which matches nothing."""
    out: list[tuple[str, str]] = []
    for f, value in request.terms:
        found = analyzed(value, mapping.kind(f))
        if not found:
            return None
        out += [(f, t) for t in found if (f, t) not in out]
    return out


def _weight(field: str, term: str, mapping: Mapping):
    if mapping.kind(field) != FieldType.STRING_SEG:
        return F.lit(0).cast("bigint")
    text = F.coalesce(F.col(field), F.lit(""))
    return tf_weight(term_count(text, term), F.greatest(token_count(text), F.lit(1)))


def hits(df: DataFrame, mapping: Mapping, request: SearchRequest, deleted: DataFrame | None = None, id_col: str = "_docid", scored: bool = True) -> DataFrame:
    """The rows that match, with their weight, by a scan of df. deleted: ids that count as documents but never match.

    The number of all documents and the frequencies of the terms among those that filters and deletions leave
    are one row, made in one scan before.
    """
    wanted = query_terms(request, mapping)
    if request.shard is not None:
        df = df.where(F.col("_shard") == request.shard)
    live = df if deleted is None else df.join(deleted.select(id_col), id_col, "left_anti")
    live = matching(live, request.filters, mapping)
    if wanted is None:
        return live.limit(0).withColumn("weight", F.lit(0).cast("bigint"))
    found = live
    for f, t in wanted:
        found = found.where(has_term(F.col(f), t, mapping.kind(f)))
    if not wanted or not scored:
        return found.withColumn("weight", F.lit(0).cast("bigint"))
    found = found.withColumn("weight", _weight(*wanted[0], mapping))
    if len(wanted) > 1:
        later = wanted[1:]
        counts = live.agg(*[F.count_if(has_term(F.col(f), t, mapping.kind(f))).alias(f"__df{i}") for i, (f, t) in enumerate(later)])
        one = df.agg(F.count("*").alias("__max")).crossJoin(counts)
        # one row, whatever the table
        found = found.crossJoin(F.broadcast(one)).withColumn("weight", ranking.folded(F.col("weight"), F.col("__max"), [F.col(f"__df{i}") for i in range(len(later))])).drop(*one.columns)
    return found


def index_hits(found: DataFrame, mapping: Mapping, request: SearchRequest, max_doc: int, columns: DataFrame | None = None, deleted: DataFrame | None = None, buckets: int = BUCKETS, scored: bool = True) -> DataFrame:
    """(_docid, weight) of the documents that match, from stored postings.

    columns: the table of _docid and stored fields, needed by filters only. Lists are cut by filters and deletions before
    their frequencies are counted, as those decide the weights.
    """
    wanted = query_terms(request, mapping)
    if wanted is None:
        return found.select("_docid", "weight").limit(0)
    allowed = None
    if request.filters:
        if columns is None:
            raise ValueError("filters need the table's columns")
        allowed = matching(columns, request.filters, mapping).select("_docid")
    if not wanted:
        base = (allowed if allowed is not None else columns.select("_docid")).withColumn("weight", F.lit(0).cast("bigint"))
        return base if deleted is None else base.join(deleted.select("_docid"), "_docid", "left_anti")

    def cut(postings: DataFrame) -> DataFrame:
        if deleted is not None:
            postings = postings.join(deleted.select("_docid"), "_docid", "left_anti")
        return postings if allowed is None else postings.join(allowed, "_docid", "left_semi")

    lists = [cut(lookup(found, f, t, buckets)) for f, t in wanted]
    both = reduce(lambda a, b: a.join(b.select("_docid"), "_docid", "left_semi"), lists)
    if not scored or len(lists) == 1:
        return both
    counts = reduce(DataFrame.crossJoin, [x.agg(F.count("*").alias(f"__df{i}")) for i, x in enumerate(lists[1:])])
    weight = ranking.folded(F.col("weight"), F.lit(max_doc), [F.col(f"__df{i}") for i in range(len(lists) - 1)])
    return both.crossJoin(F.broadcast(counts)).select("_docid", weight.alias("weight"))


def ordered(found: DataFrame, request: SearchRequest, id_col: str = "_docid") -> DataFrame:
    if request.sort_by:
        return ranking.by_field(found, request.sort_by, request.descending, id_col)
    return ranking.by_weight(found, id_col) if request.sort else ranking.by_id(found, id_col)


def over_shards(df: DataFrame, mapping: Mapping, request: SearchRequest, shards: int, id_col: str = "_docid", **how) -> DataFrame:
    """The page's (id, weight) as by shard: each gives its own best rows up to the page's end, which are merged and cut.

    Weights are those of all shards together, so the page is the same as without shards.
    """
    found = hits(df, mapping, replace(request, shard=None), id_col=id_col, **how)
    upto = request.page_size * request.page
    tops = [ordered(found.where(F.col("_shard") == i), request, id_col).limit(upto) for i in range(shards)]
    return paging.page(ordered(reduce(DataFrame.unionByName, tops), request, id_col), request.page_size, request.page)


def page(found: DataFrame, mapping: Mapping, request: SearchRequest, id_col: str = "_docid") -> DataFrame:
    """The page's rows: id, weight and the shown fields as text."""
    rows = paging.page(ordered(found, request, id_col), request.page_size, request.page)
    return project.show(rows, mapping, request.show, [id_col, "weight"] if id_col not in (request.show or mapping.fields) else ["weight"])


def facets(found: DataFrame, request: SearchRequest) -> DataFrame:
    return aggregate.gather_many(found, request.gather)


def response(found: DataFrame, mapping: Mapping, request: SearchRequest, id_col: str = "_docid") -> DataFrame:
    """One row, json: pageSize, pageNumber, totalCount, from, to, status, gather and dataDetail (the page's documents).

    A page beyond the hits has the status 'not found' and no documents.
    """
    size, first = request.page_size, request.page_size * (request.page - 1)
    rows = page(found, mapping, request, id_col)
    shown = request.show or list(mapping.fields)
    # one page's rows, in its order
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id()))
    details = rows.withColumn("__n", place).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.struct(*shown).alias("d")))), lambda x: x["d"]).alias("dataDetail"))
    total = found.agg(F.count("*").alias("totalCount"))
    out = total.crossJoin(details)
    if request.gather:
        by = facets(found, request).select("field", F.struct("value", "n").alias("x")).groupBy("field").agg(F.sort_array(F.collect_list("x")).alias("values"))
        out = out.crossJoin(by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "values")))).alias("gather")))
    for i, s in enumerate(request.statistics):
        if s.gather:
            own = aggregate.statistics_map(found, s).select(F.col("result").alias(f"__s{i}"))
        else:
            own = aggregate.statistics(found, s).select(F.max(s.alias).alias(f"__s{i}"))
        out = out.crossJoin(own)
    if request.statistics:
        names = [f"__s{i}" for i in range(len(request.statistics))]
        out = out.withColumn("statistics", F.struct(*[F.col(n).alias(f"{s.alias}_{i}") for i, (n, s) in enumerate(zip(names, request.statistics))])).drop(*names)
    there = F.col("totalCount") > first
    out = out.withColumns({"pageSize": F.lit(size), "pageNumber": F.lit(request.page), "from": F.when(there, first + 1).otherwise(0), "to": F.when(there, F.least(F.col("totalCount"), F.lit(first + size))).otherwise(0), "status": F.when(there, "OK").otherwise("not found")})
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))
