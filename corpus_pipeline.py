"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import cotraining, mixing, ngram_join, packing, quality_rules
from lodeseek.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. It is fitted on the labelled documents of sf_dir."""
    return cotraining.keep(docs, cotraining.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def quality_rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the fixed threshold of the calibrated n-gram model go."""
    return quality_rules.keep(docs, quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard similarity links, the one of the least doc_id stays."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budgets of the source tree read, as often as they are read."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, bin, slot, start, n_tokens): where each piece of each document goes."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixture),
    ("packing", packing_stage),
]

#: Trained models decide in the first stages: SQL can't express them. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the table documents; what each returns is written, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
