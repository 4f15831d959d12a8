import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import SCHEMA, rows_of
from lodeseek.llm import cotraining, quality_rules, textfeat

HELD = os.environ.get("HELD_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(HELD), reason="no tables here")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{HELD}/documents.parquet"), spark.read.parquet(f"{HELD}/labels.parquet")


def families(text):
    """Hash-free n-gram counts of one text, by families, as textfeat counts them."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words, cur = [], b""
    for b in low + b" ":
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            cur += bytes([b])
        elif cur:
            words.append(cur)
            cur = b""
    return {"char3": [low[i : i + 3] for i in range(len(low) - 2)], "char5": [low[i : i + 5] for i in range(len(low) - 4)], "word1": words, "word2": list(zip(words, words[1:]))}


def test_n_grams_are_counted_by_row():
    texts = ["One two one Two one two", "", "ab", "é€x yz", "a" * 7, "a" * 7 + "b"]
    data, off = textfeat.buffers(pa.array([*texts, None]))
    of = {name: (slots, a, b) for name, slots, a, b in textfeat.hashed(data, off)}
    for i, t in enumerate(texts):
        for name, own in families(t).items():
            slots, a, b = of[name]
            got = slots[a[i] : b[i]]
            assert len(got) == len(own)
            # equal n-grams have equal slots, and here different ones different slots
            if name != "word2":
                assert len(set(got.tolist())) == len(set(own))


def test_scoring_is_as_training_counts():
    rng = np.random.default_rng(0)
    texts = pa.array(["alpha beta beta gamma", None, "", "delta " * 500, "x"])
    w = rng.normal(size=(len(textfeat.FAMILIES), 1 << textfeat.BITS)).astype(np.float32)
    model = textfeat.TextModel(w, bias=0.3)
    expect = textfeat.features(texts).dot(w.ravel().astype(float)) + 0.3
    assert np.allclose(model.logits(texts), expect, atol=1e-4)
    old, textfeat.CHUNK = textfeat.CHUNK, 16
    try:
        assert np.allclose(model.logits(texts), expect, atol=1e-4)
    finally:
        textfeat.CHUNK = old


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@needs_data
@pytest.mark.parametrize("module", [quality_rules, cotraining])
def test_held_out_labels(spark, tables, module):
    """Trained on the labels of half of the ids, tested on the other half's."""
    documents, labels = tables
    half = F.xxhash64(F.lit(99), "doc_id") % 2 == 0
    model = module.train(documents, labels.where(half))
    got = module.score(documents, model).join(labels.where(~half).groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").toPandas()
    y, p = got["quality"].to_numpy(), got["p_quality"].to_numpy()
    assert auc(p, y) > 0.9
    assert ((p >= 0.5) == (y > 0)).mean() > 0.85
    good = got[got.quality > 0]
    kept = (good["verdict"] != "reject").mean() if module is quality_rules else good["keep"].mean()
    assert kept > 0.95


@needs_data
def test_views_exchange_labels(tables):
    model = cotraining.train(*tables, rounds=2)
    said = model.note["exchanged"]
    assert {view for _, view, _ in said} == {"text", "page"} and sum(n for *_, n in said) > 0
    assert all(n <= 2 * cotraining.EXCHANGE for *_, n in said)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, ("good clean sentence number %d with care" % i) if i % 2 else ("BUY NOW!!! $$$ click here %d" % i), "en", f"s{i % 3}", 40) for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module", [quality_rules, cotraining])
def test_messy(spark, messy, clashing, empty, small, module):
    model = module.train(messy.unionByName(small[0]), small[1])
    out = module.score(messy, model)
    assert out.count() == messy.count() and out.where("p_quality is null or isnan(p_quality)").count() == 0
    assert rows_of(module.score(clashing, model)) == rows_of(out)
    kept = module.keep(messy, model)
    assert kept.columns == messy.columns
    assert kept.count() == out.where(F.col("p_quality") >= module.REJECT).count()
    assert module.keep(clashing, model).columns == clashing.columns and module.keep(clashing, model).count() == kept.count()
    assert module.score(empty, model).count() == 0 and module.keep(empty, model).columns == empty.columns
    one = {r.doc_id: r.p_quality for r in out.where("doc_id in (103, 104)").collect()}
    if module is quality_rules:
        assert one[103] == one[104]


@pytest.mark.parametrize("module", [quality_rules, cotraining])
def test_too_few_labels_give_the_rate(spark, messy, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], LABELS)
    for documents, l in ((messy, labels), (messy, labels.limit(0)), (empty, labels)):
        p = {round(r.p_quality, 6) for r in module.score(messy, module.train(documents, l)).collect()}
        assert len(p) == 1


def test_the_sample_is_bounded(spark, small):
    for n in (1, 5, 30, 100):
        rows = quality_rules.labelled_sample(*small, per_class=n)
        y = rows["__y"].to_pylist()
        assert y.count(0) <= n and y.count(1) <= n and rows.num_rows >= 2 * min(n, 30) - 1  # a label without a document may take a place
    rows = quality_rules.labelled_sample(*small, per_class=7)
    assert rows.equals(quality_rules.labelled_sample(small[0].repartition(4), small[1].repartition(3), per_class=7))


def test_calibration():
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2.5 * z - 1)))).astype(float)
    slope, shift = textfeat.platt(z, y)
    assert abs(slope - 2.5) < 0.4 and abs(shift + 1) < 0.3
    assert textfeat.platt(z, np.ones(4000)) == (1.0, 0.0)
    assert textfeat.prior_shift(np.array([1.0, 0.0]), 0.5) == 0


def test_every_unlabelled_document_may_be_exchanged(spark, monkeypatch):
    """The surest of each view are those of a pass over all, one of each group of copies."""
    rows = [(i, ("good clean sentence number %d with care" % i) if i % 2 else ("BUY NOW!!! $$$ click here %d" % i), "en", f"s{i % 3}", 40) for i in range(60)]
    monkeypatch.setattr(cotraining, "SURE", 0.7)
    rows += [(100 + i, f"some other words {i} here", "en", "s1", 40) for i in range(2500)]
    rows += [(10_000 + i, "good clean sentence number with care " * 3, "en", "s1", 40) for i in range(5)]
    documents = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    model = cotraining.train(documents, labels, rounds=0)
    free = cotraining.unlabelled_ids(documents, labels)
    assert free.count() == 2505
    given = set()
    found, picked = cotraining.surest(documents, free, model, given)
    own = {(t, s): i for i, t, _, s, _ in reversed(rows[60:])}
    texts, langs, sources, sizes = (pa.array(c) for c in zip(*[(t, "en", s, 40) for t, s in own]))
    sure = np.log(cotraining.SURE / (1 - cotraining.SURE))
    for view, z in zip(("text", "page"), model.log_odds(texts, langs, sources, sizes)):
        at, said = picked[view]
        for y, sign in ((1, 1), (0, -1)):
            expect = np.sort(sign * z)[::-1][: cotraining.EXCHANGE]
            expect = expect[expect >= sure]
            mine = found.take(pa.array(at[said == y], pa.int64())) if (said == y).any() else found.slice(0, 0)
            got = sign * model.log_odds(*(mine[c].combine_chunks() for c in ("text", "lang", "source", "n_chars")))[view == "page"] if len(mine) else np.zeros(0)
            assert np.allclose(np.sort(got)[::-1], expect)
    assert len(given) == len(found) > 0
    again, _ = cotraining.surest(documents, free, model, set(given))
    assert not set(again["text"].to_pylist()) & set(found["text"].to_pylist())


def slot(h, salt):
    h = (h + (salt * 0x632BE59BD9B4E019)) * 0x9E3779B97F4A7C15 % 2**64
    return (h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - textfeat.BITS


def content_by_hand(text, weights, bias):
    """Log-odds of one text: each n-gram hashed by itself with Python's integers."""
    own = families(text or "")
    word = lambda w: sum((b) * pow(0x100000001B3, i, 2**64) for i, b in enumerate(w)) % 2**64
    poly = lambda c: __import__("functools").reduce(lambda h, b: (h * 0x1003F + b) % 2**64, c, 0)
    slots = [[slot(poly(c), 3) for c in own["char3"]], [slot(poly(c), 5) for c in own["char5"]], [slot(word(w), 11) for w in own["word1"]], [slot((word(b) - word(a)) % 2**64, 12) for a, b in own["word2"]]]
    return bias + sum(textfeat.SCALE * sum(float(weights[f][s]) for s in found) / (len(found) + textfeat.DAMP) for f, found in enumerate(slots))


def probability(z):
    return 1 / (1 + float(np.exp(-z)))


@needs_data
def test_every_score_by_hand(spark, tables):
    """What the queries return for documents, computed one document and one n-gram at a time."""
    documents, labels = tables
    some = documents.where("doc_id % 17 = 0 and n_chars < 4000").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "xx", "new", 7)], documents.schema))
    rows = {r.doc_id: r for r in some.collect()}
    rules, co = quality_rules.train(documents, labels), cotraining.train(documents, labels)
    got = {r.doc_id: r for r in quality_rules.score(some, rules).collect()}
    for i, r in rows.items():
        p = probability(rules.slope * content_by_hand(r.text, rules.weights, rules.bias) + rules.shift)
        assert got[i].p_quality == pytest.approx(p, abs=1e-4)
        assert got[i].verdict == ("reject" if got[i].p_quality < 0.15 else "review" if got[i].p_quality < 0.5 else "keep")
    got = {r.doc_id: r for r in cotraining.score(some, co).collect()}
    for i, r in rows.items():
        page = cotraining.page_slots(pa.array([r.lang], pa.string()), pa.array([r.source], pa.string()), pa.array([r.n_chars], pa.int64()))[0]
        zt = co.cal[0][0] * content_by_hand(r.text, co.text, co.text_bias) + co.cal[0][1]
        zp = co.cal[1][0] * (sum(float(co.page.weights[k]) for k in page) + co.page.bias) + co.cal[1][1]
        assert (got[i].p_content, got[i].p_page) == (pytest.approx(probability(zt), abs=1e-4), pytest.approx(probability(zp), abs=1e-4))
        assert got[i].p_quality == pytest.approx(probability(co.cal[2][0] * (zt + zp) + co.cal[2][1]), abs=1e-4) and got[i].keep == (got[i].p_quality >= 0.35)


def test_the_page_view_reads_no_text(spark, small):
    model = cotraining.train(*small)
    one, other = (cotraining.score(small[0].withColumn("text", t), model).select("doc_id", "p_page") for t in (F.col("text"), F.lit("something else")))
    assert rows_of(one) == rows_of(other)


def test_scoring_works_by_small_pieces(monkeypatch):
    # a worker of an executor takes little besides its batch, whatever the batch has
    texts = pa.array(["some words of a text, and more of them %d " % i * 80 for i in range(1500)])
    model = textfeat.TextModel(np.ones((len(textfeat.FAMILIES), 1 << textfeat.BITS), np.float32))
    monkeypatch.setattr(textfeat, "_powers", None)
    tracemalloc.start()
    try:
        model.logits(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 4_000_000 and peak < 12_000_000


def test_exchange_starts_no_other_python_workers(spark, small, monkeypatch):
    # rows of Python objects are unpickled by workers on the executors, besides those of the scores
    def parallelize(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    monkeypatch.setattr(cotraining, "SURE", 0.5)
    model = cotraining.train(small[0], small[1].where("doc_id < 40"), rounds=1)
    assert sum(n for *_, n in model.note["exchanged"]) > 0
