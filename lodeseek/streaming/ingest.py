"""Documents from a growing log into a table, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodeseek.functions.types import Mapping
from lodeseek.sources.load import parsed
from lodeseek.sources.table import Table

#: Table versions after which small segments are merged.
MERGE_EVERY = 20


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("offset long, body string, shard int")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def documents(records: DataFrame, mapping: Mapping) -> DataFrame:
    """The typed rows of a log's records; bodies that are no JSON objects are skipped, fields that one lacks are empty."""
    text = T.StructType([T.StructField(f, T.StringType()) for f in mapping.fields])
    return mapping.typed(parsed(records, text, "body"))


def ingest(records: DataFrame, table: Table, checkpoint: str, name: str = "log", replace: bool = False, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Starts the query that adds each micro-batch as a segment, and merges small segments now and then.

    A batch that is given again after a failure is known by its number and left out. once: what is there is
    taken in as many batches as needed, then the query ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        key = f"{name}-{number}"
        rows = documents(batch, table.mapping())
        version = table.upsert(rows, batch=key) if replace else table.add(rows, batch=key)
        if len(version.segments) >= MERGE_EVERY:
            table.merge()

    writer = records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def binlog(messages: DataFrame, start: int = 0) -> DataFrame:
    """(LogId, LogTimestamp, LogDetail) of messages (ts, detail): ids go up from start on with the time, then the contents.

    Rows are numbered within each day, side by side; each day begins where the days before it end.
    """
    rows = messages.select(F.to_date("ts").alias("day"), "ts", "detail")
    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select(F.col("day").alias("d"), (F.sum("n").over(Window.orderBy(F.asc_nulls_first("day"))) - F.col("n")).alias("before"))
    own = rows.withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("ts", "detail")))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return own.join(before, F.col("day").eqNullSafe(F.col("d"))).select((F.col("before") + F.col("i") - 1 + start).cast("bigint").alias("LogId"), seconds.alias("LogTimestamp"), F.col("detail").cast("binary").alias("LogDetail"))
