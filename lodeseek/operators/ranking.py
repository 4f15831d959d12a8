"""Weights of hits, and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf(max_doc: Column, df: Column) -> Column:
    """log10 of all documents (deleted ones too) to those that have the term."""
    return F.log10(max_doc / df)


def idf_scaled(weight: Column, max_doc: Column, df: Column) -> Column:
    return F.floor(weight * idf(max_doc, df)).cast("bigint")


def tf_idf(weight: Column, max_doc: Column, df: Column) -> Column:
    return F.floor(weight / 10000 * idf(max_doc, df) * 1000).cast("bigint")


def folded(weight: Column, max_doc: Column, later_df: Sequence[Column]) -> Column:
    """The weight of several terms in the order of the query.

    It starts as the first term's, and each later term adds the weight so far times its idf, rounded down.
    """
    for df in later_df:
        weight = weight + F.floor(weight * idf(max_doc, df)).cast("bigint")
    return weight


def by_weight(hits: DataFrame, id_col: str = "_docid") -> DataFrame:
    return hits.orderBy(F.desc("weight"), id_col)


def by_id(hits: DataFrame, id_col: str = "_docid") -> DataFrame:
    return hits.orderBy(id_col)


def by_field(hits: DataFrame, field: str, descending: bool = False, id_col: str = "_docid") -> DataFrame:
    return hits.orderBy(F.desc(field) if descending else F.asc(field), id_col)
