"""Quality classifier by co-training of two views.

The content view is the hashed n-gram model of textfeat, over the text alone. The page view sees no text, only the
columns beside it: language, source and n_chars (in half octaves), and pairs of these, each value in a slot of its hash. Each round, both views score
every document without a label in a distributed pass; either view labels those that it is surest of, and the
other one trains on them too. Copies count once, and what is labelled leaves the pool. At the end both are calibrated on labelled documents that neither trained on, their
log-odds are added, and the sum is calibrated again. Every document is scored, on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import free_name, table, written
from lodeseek.llm.quality_rules import labelled_sample, own_labels, positive_share
from lodeseek.llm.textfeat import BITS, FAMILIES, Rows, TextModel, features, fit_logistic, platt, prior_shift, sigmoid

#: Bound of what the two models are fitted on: labelled documents of each class.
SAMPLE = 1000
ROUNDS = 4
#: A view hands over at most so many pseudo-labels of each class a round, all at least this sure: the bound of unlabelled documents.
EXCHANGE, SURE = 60, 0.95
#: Documents under this combined probability are rejected.
REJECT = 0.35
#: Hash slots of the page view are 2**PAGE_BITS; so many values of each document.
PAGE_BITS, VALUES = 18, 6


def _codes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash by value; null has one of its own."""
    enc = values.cast(pa.string()).dictionary_encode()
    codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    own = [0]
    for v in enc.dictionary.to_pylist():
        h = 1469598103934665603
        for b in v.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        own.append(h)
    return np.asarray(own, np.uint64)[codes + 1]


def page_slots(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """The VALUES slots of each row in the page view."""
    said = n_chars.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    size = np.where(said < 0, 0, 1 + np.floor(2 * np.log2(1 + np.maximum(said, 0)))).astype(np.uint64)
    one = [_codes(lang), _codes(source), size]
    with np.errstate(over="ignore"):
        pairs = [one[i] * np.uint64(0x9E3779B97F4A7C15) + one[j] for i, j in ((0, 1), (0, 2), (1, 2))]
        mixed = [(x ^ (x >> np.uint64(29)) ^ np.uint64(k << 50)) * np.uint64(0xBF58476D1CE4E5B9) for k, x in enumerate([*one, *pairs])]
    return np.column_stack([((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - PAGE_BITS)).astype(np.int32) for x in mixed])


def read(texts: pa.Array, text_weights: np.ndarray, bias: float) -> np.ndarray:
    """Raw log-odds of the content view."""
    return TextModel(text_weights, bias).logits(texts)


@dataclass
class PageModel:
    weights: np.ndarray
    bias: float

    def logits(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(1) + self.bias


def fit_page(slots: np.ndarray, y: np.ndarray) -> PageModel:
    n = len(slots)
    rows = Rows(slots.ravel(), np.ones(n * VALUES, np.float32), np.arange(n + 1) * VALUES)
    return PageModel(*fit_logistic(rows, y, 1 << PAGE_BITS, steps=100, rate=0.05, l2=1e-3))


@dataclass
class CoModel:
    text: np.ndarray | None
    text_bias: float
    page: PageModel | None
    #: (slope, shift) of the content view, of the page view and of their sum; the last has the labels' share.
    cal: tuple
    note: dict

    def scores(self, texts, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by content, by page and by both."""
        if self.page is None:
            p = np.full(len(texts), sigmoid(np.array([self.text_bias]))[0])
            return p, p, p
        zt, zp = self.log_odds(texts, lang, source, n_chars)
        return sigmoid(zt), sigmoid(zp), sigmoid(self.cal[2][0] * (zt + zp) + self.cal[2][1])

    def log_odds(self, texts, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds by content and by page."""
        z, x = read(texts, self.text, self.text_bias), page_slots(lang, source, n_chars)
        return self.cal[0][0] * z + self.cal[0][1], self.cal[1][0] * self.page.logits(x) + self.cal[1][1]


_COLUMNS = ("text", "lang", "source", "n_chars")


def unlabelled_ids(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(__id) of all documents without a label, written."""
    ids = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("__id"))
    return written(ids.join(own_labels(labels, "quality"), "__id", "left_anti").distinct())


def surest(documents: DataFrame, free: DataFrame, model: CoModel, given: set[tuple[int, int]]) -> tuple[pa.Table, dict]:
    """Of all documents of free, those that the views are surest of: their rows, and {view: (rows, labels)}.

    given: (id, print) of those that had a label before; they and the new ones are in it afterwards.
    """

    @F.arrow_udf("text double, page double")
    def log_odds(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(z) for z in model.log_odds(text, lang, source, n_chars)], ["text", "page"])

    print_of = F.xxhash64(*_COLUMNS)
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("__id"), *_COLUMNS)
    # numbers only: texts stay where they are
    scored = docs.select("__id", print_of.alias("__print"), log_odds(*_COLUMNS).alias("z")).select("__id", "__print", "z.*")
    scored = written(scored.join(free, "__id", "left_semi").groupBy("__print").agg(F.min("__id").alias("__id"), F.max("text").alias("text"), F.max("page").alias("page")))
    gone = {p for _, p in given}
    sure, said = float(np.log(SURE / (1 - SURE))), {}
    for view in ("text", "page"):
        for sign in (1, -1):
            z = F.col(view) * sign
            # what was given before may be in front again
            best = scored.where(z >= sure).orderBy(z.desc(), "__print").limit(EXCHANGE + len(gone)).collect()
            said[view, sign] = [(r["__id"], r["__print"]) for r in best if r["__print"] not in gone][:EXCHANGE]
    new = sorted({x for own in said.values() for x in own})
    given.update(new)
    # at most 4 * EXCHANGE ids; rows of Python would go through workers of their own on the executors
    ids, prints = (pa.array([x[k] for x in new], pa.int64()) for k in (0, 1))
    keys = documents.sparkSession.createDataFrame(pa.table({"__id": ids, "__print": prints}))
    rows = docs.join(F.broadcast(keys.select("__id").distinct()), "__id").withColumn("__print", print_of).join(F.broadcast(keys), ["__id", "__print"]).dropDuplicates(["__id", "__print"])
    found = rows.orderBy("__id", "__print").toArrow()
    at = {x: i for i, x in enumerate(zip(found["__id"].to_pylist(), found["__print"].to_pylist()))}
    picked = {}
    for view in ("text", "page"):
        good, bad = ([at[x] for x in said[view, sign]] for sign in (1, -1))
        picked[view] = np.asarray(good + bad, int), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    return found.select(list(_COLUMNS)), picked


def _and(x: Rows, y: Rows) -> Rows:
    return Rows(np.concatenate([x.slot, y.slot]), np.concatenate([x.value, y.value]), np.concatenate([x.start, x.start[-1] + y.start[1:]]))


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE, rounds: int = ROUNDS) -> CoModel:
    own = labelled_sample(documents, labels, per_class=per_class, columns=_COLUMNS)
    y = np.asarray(own["__y"].to_pylist(), float)
    if len(y) < 8 or min((y > 0).sum(), (y <= 0).sum()) < 4:
        rate = (y.sum() + 1) / (len(y) + 2)
        return CoModel(None, float(np.log(rate / (1 - rate))), None, (), {"classes": 1})

    def both_views(rows: pa.Table) -> tuple[Rows, np.ndarray]:
        texts, *meta = (rows[c].combine_chunks() for c in _COLUMNS)
        return features(texts), page_slots(*meta)

    x_text, x_page = both_views(own)
    rng = np.random.default_rng(11)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == c))
        held[rows[: max(1, len(rows) // 4)]] = True
    test, train_rows = np.flatnonzero(held), np.flatnonzero(~held)
    sets = {"text": [train_rows, y[train_rows]], "page": [train_rows, y[train_rows]]}
    free = unlabelled_ids(documents, labels)
    rounds = 0 if free.isEmpty() else rounds
    dim, warm, given, before = len(FAMILIES) << BITS, None, [], set()
    for r in range(rounds + 1):
        warm = fit_logistic(x_text.take(sets["text"][0]), sets["text"][1], dim, steps=50 if warm is None else 12, start=warm)
        page = fit_page(x_page[sets["page"][0]], sets["page"][1])
        zt, zp = (x_text.dot(warm[0]) + warm[1])[test], page.logits(x_page[test])
        ct, cp = platt(zt, y[test]), platt(zp, y[test])
        model = CoModel(warm[0].astype(np.float32).reshape(len(FAMILIES), -1), warm[1], page, (ct, cp, (1.0, 0.0)), {})
        if r == rounds:
            break
        new, picked = surest(documents, free, model, before)
        n = len(x_page)
        if len(new):
            more = both_views(new)
            x_text, x_page = _and(x_text, more[0]), np.concatenate([x_page, more[1]])
        for view, other in (("text", "page"), ("page", "text")):
            rows, said = picked[view]
            given.append((r, view, len(rows)))
            sets[other] = [np.concatenate([sets[other][0], n + rows]), np.concatenate([sets[other][1], said])]
    zt, zp = ct[0] * zt + ct[1], cp[0] * zp + cp[1]
    slope, shift = platt(zt + zp, y[test])
    shift += prior_shift(y[test], positive_share(labels))
    model.cal = ct, cp, (slope, shift)
    right = {k: float(((v > 0) == (y[test] > 0)).mean()) for k, v in (("text", zt), ("page", zp), ("both", zt + zp))}
    model.note = {"held_out": len(test), "accuracy": right, "exchanged": given}
    return model


def probabilities(model: CoModel):
    """A column function: (text, lang, source, n_chars) -> (p_content, p_page, p_quality)."""

    @F.arrow_udf("p_content double, p_page double, p_quality double")
    def co_scores(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(p) for p in model.scores(text, lang, source, n_chars)], ["p_content", "p_page", "p_quality"])

    return co_scores("text", "lang", "source", "n_chars")


def score(docs: DataFrame, model: CoModel) -> DataFrame:
    """(doc_id, p_content, p_page, p_quality, keep) of every row.

    A null text counts as empty; a null lang, source or n_chars as a value of its own. Repeated rows give
    repeated results, a null doc_id is passed on, other columns are not read, an empty table gives no rows.
    With fewer than 4 labelled documents of a class, every document gets the labelled rate of good quality.
    """
    scored = docs.select("doc_id", probabilities(model).alias("p"))
    return scored.select("doc_id", "p.p_content", "p.p_page", "p.p_quality", (F.col("p.p_quality") >= REJECT).alias("keep"))


def keep(docs: DataFrame, model: CoModel) -> DataFrame:
    """The rows of docs that are not rejected, with the columns that they have."""
    p = free_name(docs, "co")
    return docs.withColumn(p, probabilities(model)).where(F.col(p)["p_quality"] >= REJECT).drop(p)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
