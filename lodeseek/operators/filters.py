"""Filters over stored columns. All are conditions without nulls, so they can be combined and negated freely."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.types import FieldType, Mapping, MappingError


class Op(IntEnum):
    EQ = 1
    OVER = 2
    LESS = 3
    RANGE = 4
    NOT = 5
    STR_PREFIX = 11
    STR_SUFFIX = 12
    STR_CONTAINS_ALL = 13
    STR_EQUALS_ANY = 14


@dataclass(frozen=True)
class Filter:
    """One condition. values: a list for EQ and NOT (any other operation takes start and end), or the parts of a string filter."""

    field: str
    op: Op
    start: object = None
    end: object = None
    values: tuple = ()
    #: Whether OVER and LESS leave their bound out.
    strict: bool = False


def equal(c: Column, x) -> Column:
    return c == F.lit(x)


def over(c: Column, x, strict: bool = False) -> Column:
    return c > F.lit(x) if strict else c >= F.lit(x)


def less(c: Column, x, strict: bool = False) -> Column:
    return c < F.lit(x) if strict else c <= F.lit(x)


def between(c: Column, a, b) -> Column:
    return c.between(F.lit(a), F.lit(b))


def unequal(c: Column, x) -> Column:
    """Other than x; a missing value doesn't match."""
    return c != F.lit(x)


def one_of(c: Column, values: Iterable) -> Column:
    return c.isin(list(values))


def none_of(c: Column, values: Iterable) -> Column:
    """Not in the list; a missing value matches."""
    return c.isNull() | ~c.isin(list(values))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def prefix(c: Column, parts: Iterable[str]) -> Column:
    return _any([c.startswith(p) for p in parts])


def suffix(c: Column, parts: Iterable[str]) -> Column:
    return _any([c.endswith(p) for p in parts])


def contains_all(c: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(p) for p in parts], F.lit(True)) & c.isNotNull()


def condition(f: Filter, mapping: Mapping) -> Column:
    """The condition of a filter on a mapped table.

    String filters are for STRING_SINGLE fields only and comparisons for NUMBER and DATE; any other pair of
    type and operation matches nothing. A field that isn't mapped is an error.
    """
    kind, c = mapping.kind(f.field), F.col(f.field)
    if kind in (FieldType.NUMBER, FieldType.DATE):
        to = (lambda x: F.lit(x).cast("timestamp_ntz")) if kind == FieldType.DATE else (lambda x: x)
        values = [to(v) for v in f.values]
        if f.values and f.op in (Op.EQ, Op.NOT):
            return one_of(c, values) if f.op == Op.EQ else none_of(c, values)
        if f.op == Op.EQ:
            return equal(c, to(f.start))
        if f.op == Op.OVER:
            return over(c, to(f.start), f.strict)
        if f.op == Op.LESS:
            return less(c, to(f.start), f.strict)
        if f.op == Op.RANGE:
            return between(c, to(f.start), to(f.end))
        if f.op == Op.NOT:
            return unequal(c, to(f.start))
        return F.lit(False)
    if kind == FieldType.STRING_SINGLE:
        parts = f.values or tuple(str(f.start).split(","))
        if f.op == Op.STR_PREFIX:
            return prefix(c, parts)
        if f.op == Op.STR_SUFFIX:
            return suffix(c, parts)
        if f.op == Op.STR_CONTAINS_ALL:
            return contains_all(c, parts)
        if f.op == Op.STR_EQUALS_ANY:
            return one_of(c, parts)
    return F.lit(False)


def matching(df: DataFrame, filters: Iterable[Filter], mapping: Mapping) -> DataFrame:
    """The rows that all filters match."""
    for f in filters:
        df = df.where(condition(f, mapping))
    return df


def without(df: DataFrame, tombstones: DataFrame, id_col: str = "_docid") -> DataFrame:
    """df without the rows whose id is among the tombstones."""
    return df.join(tombstones.select(id_col), id_col, "left_anti")


__all__ = ["Filter", "MappingError", "Op", "between", "condition", "contains_all", "equal", "less", "matching", "none_of", "one_of", "over", "prefix", "suffix", "unequal", "without"]
