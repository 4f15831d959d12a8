"""Field types, mappings, and the conversion of text to typed values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldType(IntEnum):
    STRING = 1
    STRING_SEG = 2
    STRING_LIST = 3
    STRING_SINGLE = 4
    NUMBER = 11
    DATE = 15
    PK = 21
    GATHER = 22
    ONLYSTORE = 30


#: Types that get postings; those that full text, prefix, suffix and contains queries are about.
INVERTED = {FieldType.STRING, FieldType.STRING_SEG, FieldType.STRING_LIST, FieldType.STRING_SINGLE, FieldType.GATHER}
#: Names of the keyword-only API, whose text fields are treated as segmented ones.
BY_NAME = {"keyword": FieldType.STRING, "text": FieldType.STRING_SEG} | {t.name.lower(): t for t in FieldType}
#: A number whose low 32 bits are all ones is a missing one.
MISSING = (1 << 32) - 1


class MappingError(ValueError):
    pass


def spark_type(kind: FieldType) -> T.DataType:
    return {FieldType.NUMBER: T.LongType(), FieldType.DATE: T.TimestampNTZType()}.get(kind, T.StringType())


def parse_number(text: Column) -> Column:
    """An integer literal in decimal, 0x, 0b, 0o or with a leading 0 (octal), with sign and single underscores between digits.

    Null for anything else (surrounding blanks included), beyond 64 bits, and for the values that mean missing.
    """
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    body = F.lower(F.regexp_replace(text, "^[+-]", ""))

    def based(prefix: str, digits: str, base: int, most: int) -> Column:
        kept = F.regexp_replace(F.regexp_replace(body, f"^{prefix}", ""), "_", "")
        kept = F.regexp_replace(kept, "^0+(?=.)", "")
        value = F.when(F.length(kept) <= most, F.conv(F.substring(kept, 1, most), base, 10))
        return F.when(body.rlike(f"^{prefix}(_?[{digits}])+$"), F.concat(sign, value))

    plain = F.when(body.rlike("^(0|[1-9](_?[0-9])*)$"), F.concat(sign, F.regexp_replace(body, "_", "")))
    found = F.coalesce(plain, based("0x", "0-9a-f", 16, 16), based("0b", "01", 2, 64), based("0o", "0-7", 8, 22), based("0", "0-7", 8, 22))
    number = F.when(F.length(found) <= 20, found).try_cast("bigint")
    return known(number)


def known(number: Column) -> Column:
    """number, or null where its value is one that means missing."""
    number = number.cast("bigint")
    return F.when(number.bitwiseAND(F.lit(MISSING)) != F.lit(MISSING), number)


def fixed_point(value: Column) -> Column:
    """A fraction as hundredths, cut towards zero."""
    return F.expr("bigint(0)") + (value * 100).cast("bigint")


def parse_date(text: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss', or 'yyyy-MM-dd' for texts of at most 10 bytes; null for anything else."""
    long, short = (F.to_timestamp_ntz(F.when(text.rlike(p), text), F.lit(f)) for p, f in ((r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]) ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$", "yyyy-MM-dd")))
    # a day that its month hasn't is no date: casting it is what fails softly
    real = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    return F.when(real & (F.octet_length(text) > 10), long).when(real & (F.octet_length(text) == 10), short)


def show_value(value: Column, kind: FieldType) -> Column:
    """A stored value as text; missing ones are empty."""
    if kind == FieldType.DATE:
        return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


@dataclass
class Mapping:
    """The declared fields of a table, in order."""

    name: str
    fields: dict[str, FieldType] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, /, **fields: FieldType | str | int) -> Mapping:
        out = cls(name)
        for f, kind in fields.items():
            out.add(f, kind)
        return out

    @property
    def primary_key(self) -> str | None:
        return next((f for f, k in self.fields.items() if k == FieldType.PK), None)

    def add(self, name: str, kind: FieldType | str | int) -> None:
        kind = BY_NAME[kind.lower()] if isinstance(kind, str) else FieldType(kind)
        if name in self.fields:
            raise MappingError(f"field {name} is there already")
        if kind == FieldType.PK and self.primary_key:
            raise MappingError("there is a primary key already")
        self.fields[name] = kind

    def drop(self, name: str) -> bool:
        """False if there is no such field. The primary key stays."""
        if self.fields.get(name) == FieldType.PK:
            raise MappingError("the primary key can't be dropped")
        return self.fields.pop(name, None) is not None

    def kind(self, name: str) -> FieldType:
        if name not in self.fields:
            raise MappingError(f"there is no field {name}")
        return self.fields[name]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f, spark_type(k)) for f, k in self.fields.items()])

    def to_json(self) -> str:
        return json.dumps({"indexname": self.name, "indexmapping": [{"fieldname": f, "fieldtype": int(k)} for f, k in self.fields.items()]})

    @classmethod
    def from_json(cls, text: str) -> Mapping:
        """The request that creates a table; of a field declared twice the first declaration counts."""
        said = json.loads(text)
        out = cls(said["indexname"])
        for f in said["indexmapping"]:
            if f["fieldname"] not in out.fields:
                out.add(f["fieldname"], f["fieldtype"])
        return out

    def typed(self, raw: DataFrame) -> DataFrame:
        """Text columns converted to the mapped fields, in their order. Other columns go; missing ones count as empty text."""
        def value(name: str, kind: FieldType) -> Column:
            text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in raw.columns else F.lit("")
            if kind == FieldType.NUMBER:
                return parse_number(text)
            return parse_date(text) if kind == FieldType.DATE else text

        return raw.select(*[value(f, k).alias(f) for f, k in self.fields.items()])
