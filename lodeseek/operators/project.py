"""Columns of hits, lookups by id or key, and enrichment from other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.types import FieldType, Mapping, show_value


def show(hits: DataFrame, mapping: Mapping, fields: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Fields as text (all mapped ones by default), after the columns keep as they are. A field that isn't mapped is empty."""
    names = list(fields) or list(mapping.fields)
    return hits.select(*keep, *[(show_value(F.col(f), mapping.fields[f]) if f in mapping.fields else F.lit("")).alias(f) for f in names])


def get_document(df: DataFrame, mapping: Mapping, docid: int, id_col: str = "_docid") -> DataFrame:
    """The row of a document id: all mapped fields but the key, as text."""
    return show(df.where(F.col(id_col) == F.lit(docid)), mapping, [f for f, k in mapping.fields.items() if k != FieldType.PK], [id_col])


def get_fields(df: DataFrame, mapping: Mapping, docid: int, fields: Sequence[str], id_col: str = "_docid") -> DataFrame:
    """The named fields of a document; no row if none of them is mapped."""
    if not any(f in mapping.fields for f in fields):
        return show(df.limit(0), mapping, fields, [id_col])
    return show(df.where(F.col(id_col) == F.lit(docid)), mapping, fields, [id_col])


def by_key(current: DataFrame, mapping: Mapping, key: object) -> DataFrame:
    """The live row of a primary key."""
    return current.where(F.col(mapping.primary_key) == F.lit(key))


def enriched(hits: DataFrame, details: DataFrame, on: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """hits with columns (name there -> name here) of the detail rows of the same keys; null where there is none.

    Spark picks the join: by broadcast where details is small by its statistics, by sort and merge otherwise.
    """
    return hits.join(details.select(*on, *[F.col(a).alias(b) for a, b in columns.items()]), list(on), "left")
