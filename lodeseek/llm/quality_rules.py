"""Quality rules: a hashed n-gram logistic regression, calibrated, against fixed thresholds.

The model is trained on labelled documents, bounded by SAMPLE per class; every document is scored on its
whole text, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import free_name, table
from lodeseek.llm.textfeat import TextModel, fit_text_model, sigmoid

#: At most so many labelled documents of each class train the model: the bound of the training sample.
SAMPLE = 1000
#: p under REJECT is rejected, under REVIEW kept but marked.
REJECT, REVIEW = 0.15, 0.5


def own_labels(labels: DataFrame, target: str) -> DataFrame:
    """(__id, __y): one class of each labelled id, the larger where repeated rows disagree; nulls are left out."""
    return labels.where(f"doc_id is not null and {target} is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col(target) > 0).cast("int")).alias("__y"))


def positive_share(labels: DataFrame, target: str = "quality") -> float | None:
    """Share of the positive class among all labelled ids; None without labels."""
    return own_labels(labels, target).agg(F.avg("__y")).first()[0]


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = SAMPLE, columns: tuple[str, ...] = ("text",)) -> pa.Table:
    """Up to per_class labelled documents of each class, those of the least hash of their id, as an Arrow table.

    Rows with a null id, label or text are left out; of repeated label rows any one counts (the largest label).
    """
    own = own_labels(labels, target)
    key = F.xxhash64(F.lit(17), F.col("__id"))
    picks = [own.where(f"__y = {c}").orderBy(key, "__id").limit(per_class) for c in (0, 1)]
    bounded = picks[0].unionByName(picks[1])
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("__id"), *[F.col(c) for c in columns])
    # at most 2 * per_class rows of (id, class), whatever the input
    rows = docs.join(F.broadcast(bounded), "__id").groupBy("__id", "__y").agg(*[F.min_by(c, F.col("text")).alias(c) for c in columns if c != "text"], F.min("text").alias("text"))
    return rows.orderBy("__id").toArrow()


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> TextModel:
    rows = labelled_sample(documents, labels, per_class=per_class)
    return fit_text_model(rows["text"], np.asarray(rows["__y"].to_pylist(), float), positive_share(labels))


def probability(model: TextModel):
    """A column function: text -> calibrated probability of good quality."""

    @F.arrow_udf("double")
    def p_quality(text: pa.Array) -> pa.Array:
        return pa.array(sigmoid(model.logits(text)))

    return p_quality


def score(docs: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, p_quality, verdict) of every row.

    verdict: 'reject' under REJECT, 'review' under REVIEW, else 'keep'. A null text scores as the empty
    text, whose probability is the model's bias alone. Repeated rows give repeated results; a null doc_id
    is passed on; other columns are not read. An empty table gives no rows. With fewer than 4 labelled
    documents of a class, every document gets the labelled rate of good quality.
    """
    return docs.select(F.col("doc_id"), probability(model)(F.col("text")).alias("p_quality")).withColumn("verdict", F.when(F.col("p_quality") < REJECT, "reject").when(F.col("p_quality") < REVIEW, "review").otherwise("keep"))


def keep(docs: DataFrame, model: TextModel) -> DataFrame:
    """The rows of docs that are not rejected, with the columns that they have."""
    p = free_name(docs, "p_quality")
    return docs.withColumn(p, probability(model)(F.col("text"))).where(F.col(p) >= REJECT).drop(p)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
