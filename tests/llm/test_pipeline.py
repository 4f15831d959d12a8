"""run() against a version that takes each decision row by row."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from llm_helpers import SCHEMA, messy_rows, prose
from pyspark.sql import functions as F
from test_mixing import brute as brute_mix
from test_ngram_join import survivors

import corpus_pipeline
from lodeseek.llm import cotraining, packing, quality_rules

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rnd = random.Random(8)
    rows = messy_rows()
    for i in range(500, 640):
        good = prose(rnd, rnd.randint(20, 80))
        rows.append((i, good if i % 3 else "BUY NOW!!! $$$ CLICK HERE " * rnd.randint(3, 9) + str(i), "en", f"src{i % 5}", 100))
    rows += [(700 + j, rows[60 + j][1] + " tail", "en", "src1", 1) for j in range(10)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(500, 640)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_as_by_hand(spark, tables):
    documents, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    rows = [tuple(r) for r in documents.collect()]
    col = lambda i, t: pa.array([r[i] for r in rows], t)
    model = cotraining.train(documents, labels)
    p = model.scores(col(1, pa.string()), col(2, pa.string()), col(3, pa.string()), col(4, pa.int64()))[2]
    first = [r for r, x in zip(rows, p) if x >= cotraining.REJECT]
    model = quality_rules.train(documents, labels)
    second = [r for r in first if quality_rules.sigmoid(model.logits(pa.array([r[1]], pa.string())))[0] >= quality_rules.REJECT]
    assert len(first) < len(rows) and len(second) <= len(first)
    third = survivors(second)
    assert len(third) < len(second)
    reads = brute_mix(third)
    expect = Counter()
    for (i, _, _, _, take), n in reads.items():
        expect[i] += take * n
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "bin", "slot", "start", "n_tokens"]
    got, bins = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += r.n_tokens
        bins[r.bin] += r.n_tokens
    assert got == expect and max(bins.values()) <= packing.CAPACITY


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        wide = stage(spark, docs.withColumns({"own": F.lit(1), "row": F.lit(2), "p": F.lit(3), "t": F.lit(4)}), tables)
        assert wide.columns == [*docs.columns, "own", "row", "p", "t"] and wide.count() == out.count(), name


def test_clean_documents_stay(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = {i for i, q, _ in corpus()[1] if q}
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = {r.doc_id for r in stage(spark, docs, tables).collect()}
        assert len(good - kept) <= 0.03 * len(good)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
