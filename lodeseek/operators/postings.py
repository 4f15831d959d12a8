"""The inverted index as a table: (field, term, _docid, weight), partitioned by field and term bucket.

The bucket of a term is known when a query is planned, so a lookup reads one folder, and within its files,
sorted by term, only the row groups that can hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.analysis import terms
from lodeseek.functions.types import INVERTED, FieldType, Mapping

BUCKETS = 64
#: Document ids of a file of postings.
SPAN = 1 << 22
#: What a weight of 1 is written as.
SCALE = 10_000


def bucket(term: Column | str, buckets: int = BUCKETS):
    """The bucket of a term: a number for a string, a column for a column; both agree."""
    if isinstance(term, str):
        return zlib.crc32(term.encode()) % buckets
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def tf_weight(tf: Column, n: Column) -> Column:
    """Share of a term among the tokens of its document, in SCALE parts, rounded down."""
    return F.floor(tf / n * SCALE).cast("bigint")


def _runs(t: Column) -> Column:
    """(term, tf) of each distinct element of an array: its elements in order, cut where a new one begins."""

    def cut(s: Column) -> Column:
        last = F.size(s) - 1
        starts = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("bigint").alias("tf"))))[0]

    # by way of one-element arrays: so each is computed once, and not again for each element
    return F.transform(F.array(F.sort_array(t)), cut)[0]


def term_frequencies(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(_docid, term, tf, n): how often each token stands in each row, of n tokens. Counted where the row is, without a shuffle."""
    t = terms(F.col(field), FieldType.STRING_SEG)
    rows = df.select(F.col(id_col).alias("_docid"), t.alias("t")).select("_docid", F.size("t").cast("bigint").alias("n"), F.explode(_runs(F.col("t"))).alias("r"))
    return rows.select("_docid", "r.term", "r.tf", "n")


def field_postings(df: DataFrame, id_col: str, field: str, kind: FieldType) -> DataFrame:
    """(field, term, _docid, weight) of one field. Only segmented text has weights; other types have 0.

    Null text counts as empty: an empty string is a term of every type but segmented text and characters.
    """
    text = F.coalesce(F.col(field), F.lit(""))
    if kind == FieldType.STRING_SEG:
        found = term_frequencies(df.select(F.col(id_col), text.alias(field)), id_col, field)
        return found.select(F.lit(field).alias("field"), "term", "_docid", tf_weight(F.col("tf"), F.col("n")).alias("weight"))
    return df.select(F.lit(field).alias("field"), F.explode(F.array_distinct(terms(text, kind))).alias("term"), F.col(id_col).alias("_docid"), F.lit(0).cast("bigint").alias("weight"))


def postings(df: DataFrame, mapping: Mapping, id_col: str = "_docid") -> DataFrame:
    """The postings of all fields whose type has any."""
    parts = [field_postings(df, id_col, f, k) for f, k in mapping.fields.items() if k in INVERTED]
    return reduce(DataFrame.unionByName, parts)


def keyword_postings(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """Postings of a column of keywords: a string, or an array of which each element is a term, once a document."""
    is_list = df.schema[field].dataType.typeName() == "array"
    values = F.array_distinct(F.col(field)) if is_list else F.array(field)
    return df.select(F.lit(field).alias("field"), F.explode(values).alias("term"), F.col(id_col).alias("_docid"), F.lit(0).cast("bigint").alias("weight")).where("term is not null")


def doc_frequencies(found: DataFrame) -> DataFrame:
    """(field, term, df): in how many documents each term stands."""
    return found.groupBy("field", "term").agg(F.count("*").alias("df"))


def term_documents(df: DataFrame, field: str) -> DataFrame:
    """(field, term, df) of segmented text: the only shuffle is that of the counts."""
    t = F.array_distinct(terms(F.coalesce(F.col(field), F.lit("")), FieldType.STRING_SEG))
    return df.select(F.explode(t).alias("term")).groupBy("term").agg(F.count("*").alias("df")).select(F.lit(field).alias("field"), "term", "df")


def posting_lists(found: DataFrame) -> DataFrame:
    """(field, term, df, docs): each term's postings as one array by document."""
    return found.groupBy("field", "term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list(F.struct("_docid", "weight"))).alias("docs"))


def write_postings(found: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Writes postings for lookup: one shuffle, to field, bucket and range of SPAN ids, and files sorted by term and document.

    The list of a frequent term, or of a field of few terms, is so in as many files as there are ranges.
    """
    b = found.withColumn("bucket", bucket(F.col("term"), buckets))
    b.repartition("field", "bucket", F.floor(F.col("_docid") / SPAN)).sortWithinPartitions("field", "bucket", "term", "_docid").write.mode(mode).partitionBy("field", "bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, _docid long, weight long, field string, bucket int").parquet(path)


def lookup(found: DataFrame, field: str, term: str, buckets: int = BUCKETS) -> DataFrame:
    """(_docid, weight) of one term of a stored index: the partition is chosen while planning."""
    if "bucket" in found.columns:
        found = found.where(F.col("bucket") == bucket(term, buckets))
    return found.where((F.col("field") == field) & (F.col("term") == term)).select("_docid", "weight")


def lookup_any(found: DataFrame, field: str, wanted: Iterable[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, _docid, weight) of several terms, from their partitions only."""
    wanted = list(wanted)
    if "bucket" in found.columns:
        found = found.where(F.col("bucket").isin(sorted({bucket(t, buckets) for t in wanted})))
    return found.where((F.col("field") == field) & F.col("term").isin(wanted)).select("term", "_docid", "weight")


def nth(found: DataFrame, term: str, n: int) -> DataFrame:
    """The n-th posting (from 0) of a term, by document; no row where there is none. No more than n + 1 of a partition are kept."""
    return found.where(F.col("term") == term).select("_docid", "weight").orderBy("_docid").offset(n).limit(1)


def posting_of(found: DataFrame, term: str, doc: int) -> DataFrame:
    """(_docid, weight) of one document in a term's postings; no row where it hasn't the term."""
    return found.where((F.col("term") == term) & (F.col("_docid") == doc)).select("_docid", "weight")


def merged(*parts: DataFrame) -> DataFrame:
    """Postings of several segments as one, in the order of terms and documents."""
    return reduce(DataFrame.unionByName, parts).repartition("field", "term").sortWithinPartitions("field", "term", "_docid")
