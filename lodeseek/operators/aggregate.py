"""Facets and statistics over hits: one aggregation with partial sums before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.filters import Op


def gather(hits: DataFrame, field: str) -> DataFrame:
    """(field, n): hits of each value, over all hits and not a page of them. Missing values count as one."""
    return hits.groupBy(field).agg(F.count("*").alias("n"))


def gather_many(hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n): independent facets of several fields in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return hits.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def _aggregate(op: str, c: Column) -> Column:
    ops = {"count": lambda x: F.count("*"), "sum": F.sum, "avg": F.avg, "avg_int": lambda x: F.floor(F.avg(x)).cast("bigint"), "max": F.max, "min": F.min}
    if op not in ops:
        raise ValueError(f"no statistic {op}")
    return ops[op](c)


@dataclass(frozen=True)
class Statistic:
    """op of field by the values of gather; having, if given, is a comparison that the statistic must hold."""

    op: str
    field: str | None
    gather: str | None
    having: Op | None = None
    start: object = None
    end: object = None
    alias: str = "value"


def _holds(c: Column, s: Statistic) -> Column:
    return {
        Op.EQ: lambda: c == F.lit(s.start),
        Op.OVER: lambda: c >= F.lit(s.start),
        Op.LESS: lambda: c <= F.lit(s.start),
        Op.RANGE: lambda: c.between(F.lit(s.start), F.lit(s.end)),
        Op.NOT: lambda: c != F.lit(s.start),
    }[s.having]()


def statistics(hits: DataFrame, s: Statistic) -> DataFrame:
    """(gather, value), or (value) of all hits; missing values of the field are left out, as are groups that having rejects."""
    value = _aggregate(s.op, F.col(s.field) if s.field else F.lit(1)).alias(s.alias)
    out = hits.groupBy(s.gather).agg(value) if s.gather else hits.agg(value)
    return out if s.having is None else out.where(_holds(F.col(s.alias), s))


def statistics_map(hits: DataFrame, s: Statistic) -> DataFrame:
    """One row: result_count, and the statistic of each group as a map. For facets, whose values are few."""
    by = statistics(hits, s).select(F.col(s.gather).cast("string").alias("k"), F.col(s.alias).alias("v")).where("k is not null")
    return by.agg(F.count("*").alias("result_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("result"))


def contacts(hits: DataFrame, id_col: str) -> DataFrame:
    """(n, ids): how many hits there are, and which, in order: for a result that is handed over as a whole."""
    return hits.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id_col)).alias("ids"))


def contact_flags(df: DataFrame, id_col: str, contact: object, condition: Column) -> DataFrame:
    """One row: is the contact there, and does any of its rows match."""
    own = df.where(F.col(id_col) == F.lit(contact))
    return own.agg((F.count("*") > 0).alias("has_contact"), F.coalesce(F.max(condition), F.lit(False)).alias("matches"))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
