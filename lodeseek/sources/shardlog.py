"""A replayable log of documents by shard: appended in batches, pulled by offset, or streamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "shard int, offset long, body string"


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a numeric key; a null one goes to shard 0."""
    return F.coalesce(F.pmod(key.cast("bigint"), F.lit(shards)), F.lit(0)).cast("int")


def records(docs: DataFrame, shards: int, key: str | None = None, order_by: str | None = None, start: dict[int, int] | None = None) -> DataFrame:
    """(shard, offset, body) of documents as JSON objects: offsets of a shard are dense and start where it ended.

    A shard is numbered by one task, so a load runs on as many tasks as there are shards.
    Without a numeric key, documents go to shards by a hash of their contents, the same way each time.
    """
    body = F.to_json(F.struct(*docs.columns))
    shard = shard_of(F.col(key), shards) if key else F.pmod(F.xxhash64(*docs.columns), F.lit(shards)).cast("int")
    over = Window.partitionBy("shard").orderBy(*([order_by] if order_by else []), "body")
    first = F.coalesce(*[F.when(F.col("shard") == s, n) for s, n in (start or {}).items()], F.lit(0)).cast("bigint")
    out = docs.select(shard.alias("shard"), body.alias("body"), *([F.col(order_by)] if order_by else []))
    return out.select("shard", (F.row_number().over(over) - 1 + first).cast("bigint").alias("offset"), "body")


def append(spark: SparkSession, path: str, docs: DataFrame, shards: int, key: str | None = None, order_by: str | None = None) -> None:
    """Adds documents behind what the log has: one writer at a time."""
    try:
        ends = {r.shard: r.n for r in read(spark, path).groupBy("shard").agg((F.max("offset") + 1).alias("n")).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ends = {}
    records(docs, shards, key, order_by, ends).repartition("shard").sortWithinPartitions("shard", "offset").write.mode("append").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("offset long, body string, shard int").parquet(path).select("shard", "offset", "body")


def pull(log: DataFrame, shard: int, start: int, count: int) -> DataFrame:
    """Up to count records of a shard from offset start on, in order. Offsets are dense, so it is a range and no sort of the log."""
    return log.where((F.col("shard") == shard) & (F.col("offset") >= start) & (F.col("offset") < start + count)).orderBy("offset")


def next_offset(pulled: DataFrame, start: int) -> int:
    last = pulled.agg(F.max("offset")).first()[0]
    return start if last is None else last + 1
