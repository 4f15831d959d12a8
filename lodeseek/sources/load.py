"""Documents from files, databases and single pushes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.types import Mapping
from lodeseek.sources.table import Table, Version


def delimited(spark: SparkSession, path: str, fields: Sequence[str], split: str = "\t") -> DataFrame:
    """Lines with exactly as many parts as there are fields, as text columns; others are dropped."""
    parts = F.split("value", f"\\Q{split}\\E", -1)
    return cut(spark.read.text(path), fields, parts)


def cut(lines: DataFrame, fields: Sequence[str], parts) -> DataFrame:
    return lines.select(parts.alias("p")).where(F.size("p") == len(fields)).select(*[F.col("p")[i].alias(f) for i, f in enumerate(fields)])


def json_lines(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    """The mapped fields of JSON lines, as text columns. Lines that are no JSON objects are dropped."""
    text = T.StructType([T.StructField(f, T.StringType()) for f in mapping.fields])
    return parsed(spark.read.text(path), text)


def parsed(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON objects of a text column; what can't be read is dropped."""
    bad = "__bad"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    found = lines.select(F.from_json(F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("d"), F.col(column).alias("__line"))
    return found.where(f"d is not null and d.{bad} is null and ltrim(__line) like '{{%'").select(*[F.col("d")[f.name].alias(f.name) for f in schema.fields])


def database(spark: SparkSession, url: str, query: str, columns: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """Rows of a query by JDBC, columns renamed (column there -> field). With key and bounds it is read in parts, side by side."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key and bounds:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    else:
        reader = reader.option("query", query)
    return reader.load().select(*[F.col(a).alias(b) for a, b in columns.items()])


def push(table: Table, document: dict[str, str]) -> Version:
    """One document of text values: converted, and put in the place of what has its key."""
    mapping = table.mapping()
    known = {f: str(v) for f, v in document.items() if f in mapping.fields}
    raw = table.spark.createDataFrame([tuple(known.values())], T.StructType([T.StructField(f, T.StringType()) for f in known]))
    return table.upsert(mapping.typed(raw))


def load(table: Table, raw: DataFrame, merge: bool = False, replace: bool = False) -> Version:
    """Text columns, converted and added (or upserted); then segments are merged, if asked for."""
    typed = table.mapping().typed(raw)
    v = table.upsert(typed) if replace else table.add(typed)
    return table.merge() if merge else v
