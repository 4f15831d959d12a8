"""Set operations on posting lists (_docid, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersection(*lists: DataFrame) -> DataFrame:
    """Documents in all lists, with the first one's weight."""
    return reduce(lambda a, b: a.join(b.select("_docid"), "_docid", "left_semi"), lists)


def union(*lists: DataFrame) -> DataFrame:
    """Documents of any list, each once, with its largest weight."""
    return reduce(DataFrame.unionByName, lists).groupBy("_docid").agg(F.max("weight").alias("weight"))


def union_of_postings(*lists: DataFrame) -> DataFrame:
    """All postings of the lists; those that are the same in document and weight once."""
    return reduce(DataFrame.unionByName, lists).dropDuplicates(["_docid", "weight"])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("_docid"), "_docid", "left_anti")


def concatenation(*segments: DataFrame) -> DataFrame:
    """Results of segments, one after the other; no document is in two of them."""
    return reduce(DataFrame.unionByName, segments)
