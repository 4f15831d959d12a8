"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token, for counting and cutting: a run of anything but space, tab and line ends.
TOKEN = "[^ \\t\\n\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is unset (local tests) a folder of this machine is taken and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodeseek-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, sort_by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and the loss of an executor costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def n_tokens(text: Column) -> Column:
    """Number of tokens of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
