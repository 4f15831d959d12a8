import random

import numpy as np
import pytest

from llm_helpers import SCHEMA, WORDS, messy_rows, prose, rows_of
from pyspark.sql import functions as F

from lodeseek.llm import ngram_join as nj


def words(text):
    out, cur = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            out += [cur] * bool(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] * bool(cur)


def grams(text, n=nj.N):
    w = words(text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, t=nj.T):
    """(doc_id, class_id, links) of each row, each row against each."""
    own = [grams(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)
    for x, a in enumerate(own):
        for y, b in enumerate(own[:x]):
            if a and b and len(a & b) >= t * len(a | b):
                links[x] += 1
                links[y] += 1
                root = [root[y] if r == root[x] else r for r in root]
    out = []
    for x, r in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if root[y] == root[x] and rows[y][0] is not None]
        out.append((r[0], min(ids, default=None) if own[x] else r[0], links[x]))
    return sorted(out, key=repr)


def near_copies(seed, groups=12):
    rnd = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(rnd.choice([6, 30, 80, 400, 900]))]
        for _ in range(rnd.randint(1, 6)):
            own = [rnd.choice(WORDS) if rnd.random() < rnd.choice([0, 0.02, 0.08]) else w for w in base]
            rows.append((i, " ".join(own), "en", "s", 1))
            i += 1
    passage = " ".join(f"shared{j}" for j in range(60))
    rows += [(i + j, prose(rnd, 100) + " " + passage + f" own{j} " * 3, "en", "s", 1) for j in range(20)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_messy(spark, messy, clashing):
    got = rows_of(nj.classes(messy))
    assert got == brute(messy_rows())
    assert rows_of(nj.classes(clashing)) == got


@pytest.mark.parametrize("x", [0, 10**6])
def test_light_and_heavy_give_the_same(spark, monkeypatch, x):
    """Whatever the boundary: all groups by lists, all by subsets (by cost in the other tests)."""
    rows = near_copies(1)
    monkeypatch.setattr(nj, "boundary", lambda *a: x)
    assert rows_of(nj.classes(frame(spark, rows))) == brute(rows)


def test_however_the_work_is_split(spark, monkeypatch):
    for name, value in (("MEMBERS", 2), ("VISITS", 3), ("BLOCK", 500), ("PER_BUCKET", 100), ("PER_SETS", 50), ("SPARSE_NS", 0.0)):
        monkeypatch.setattr(nj, name, value)
    rows = near_copies(1)
    assert rows_of(nj.classes(frame(spark, rows))) == brute(rows)


def test_sets_alone_in_their_groups(spark, monkeypatch):
    """Groups of one set each, so that all links go through the join of groups."""
    rows = near_copies(2)
    plain = nj._prefixes
    monkeypatch.setattr(nj, "_prefixes", lambda *a: plain(*a).withColumn("key", F.col("sid")))
    assert rows_of(nj.classes(frame(spark, rows))) == brute(rows)


def test_a_passage_of_very_many_rows(spark):
    """Its n-grams skip the buckets: alone, as most of a short text, and as little of a long one."""
    rnd = random.Random(3)
    passage = prose(rnd, 70)
    rows = [(i, f"{passage} {prose(rnd, rnd.choice([0, 10, 40, 70, 300]))}", "en", "s", 1) for i in range(90)]
    sig, hot = nj.signatures(frame(spark, rows, 1))
    assert hot and sig.count() == 90
    assert rows_of(nj.classes(frame(spark, rows, 1))) == brute(rows)


def test_other_ids(spark):
    rows = near_copies(5, 4)
    got = rows_of(nj.classes(spark.createDataFrame([(f"d{r[0]:05}", r[1]) for r in rows], "doc_id string, text string")))
    assert got == sorted([(f"d{a:05}", f"d{b:05}", n) for a, b, n in brute(rows)], key=repr)


def test_dense_and_sparse_products_agree(monkeypatch):
    rnd = np.random.default_rng(4)
    own, other = ([np.unique(rnd.integers(0, 300, rnd.integers(0, 90))).astype(np.uint64) for _ in range(k)] for k in (23, 17))
    cells = []
    for ns in (0.0, 1e9):
        monkeypatch.setattr(nj, "SPARSE_NS", ns)
        cell = nj._Cell(np.arange(23), np.asarray([len(x) for x in own]), np.ones(23, np.int64), [nj.pack48(x) for x in own], True, 0.5)
        cells.append(nj._common(cell.own, np.repeat(np.arange(17), [len(x) for x in other]), np.concatenate(other), 17))
    assert (cells[0] == cells[1]).all() and (cells[0] == [[len(np.intersect1d(a, b)) for b in other] for a in own]).all()


def test_boundary_is_of_least_cost():
    costs = [(2, 100, 50.0), (5, 80, 4000.0), (9, 10, 90.0), (30, 5, 400.0), (40, 3, 10**7)]

    def cost(x):
        return sum(k * q * (q - 1) / 2 if q <= x else k * q + nj.SCAN_COST * s for q, k, s in costs)

    assert cost(nj.boundary(costs)) == min(cost(x) for x in [0, *[q for q, _, _ in costs]])
    assert nj.boundary([]) == 0


def test_empty(spark, empty):
    assert nj.classes(empty).count() == 0 and nj.one_of_each(empty).columns == empty.columns and nj.one_of_each(empty).count() == 0
    no_words = spark.createDataFrame([(1, "", "", "", 1), (2, None, "", "", 1), (3, "!!", "", "", 1)], empty.schema)
    assert rows_of(nj.classes(no_words)) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)] and nj.one_of_each(no_words).count() == 3


def survivors(rows):
    best = {}
    for r, (_, root, _) in zip(rows, by_place(rows)):
        if grams(r[1]):
            best.setdefault(root, []).append(r)
    stays = [min(v, key=lambda r: (r[0] is not None, r[0] or 0)) for v in best.values()]
    return sorted([tuple(r) for r in stays] + [tuple(r) for r in rows if not grams(r[1])], key=repr)


def by_place(rows):
    return sorted(brute([(i, *r[1:]) for i, r in enumerate(rows)]))


def test_one_of_each_group_stays(spark, messy, clashing):
    kept = nj.one_of_each(messy)
    assert kept.columns == messy.columns
    got, expect = rows_of(kept), survivors(messy_rows())
    assert got == expect
    assert nj.one_of_each(clashing).columns == clashing.columns
    assert rows_of(nj.one_of_each(clashing).select(*messy.columns)) == got


def test_groups_of_near_copies(spark):
    rows = [r for r in near_copies(3, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r[0] for r in rows_of(nj.one_of_each(df).select("doc_id"))}
    assert got == {r[0] for r in survivors(rows)}


def data_size(df):
    """Bytes of the broadcasts of df, as Spark counts them."""

    def walk(node):
        own = node.metrics().apply("dataSize").value() if node.nodeName() == "BroadcastExchange" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        return walk(df._jdf.queryExecution().executedPlan())
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_keys_that_are_sent_fit_a_small_driver(spark):
    """Two times FEW keys, built at once, take no more than a third of a heap of 750 MB."""
    n = min(nj.FEW, 400_000)
    rows = spark.range(2 * n).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("own"), "id")
    size = data_size(rows.join(F.broadcast(rows.where(f"id < {n}").select("own")), "own", "left_anti").selectExpr("count(*)"))
    assert 0 < 2 * nj.FEW * size / n < 250e6


def test_more_keys_than_are_sent(spark, messy, clashing, monkeypatch):
    expect = rows_of(nj.one_of_each(messy))
    for most in (nj.MOST_BITS, 15):  # the latter lets nearly half of the rows through that are none of the keys
        monkeypatch.setattr(nj, "MOST_BITS", most)
        monkeypatch.setattr(nj, "FEW", 0)
        assert rows_of(nj.one_of_each(messy)) == expect == survivors(messy_rows())
        assert rows_of(nj.one_of_each(clashing).select(*messy.columns)) == expect


def test_rows_that_are_no_key_stay_where_they_are(spark):
    rows = spark.range(40_000).selectExpr("id as own")
    keys = rows.where("own % 4 = 0")
    some, rest = nj._apart(rows, "own", keys, 10_000)
    assert some.unionByName(rest).distinct().count() == some.count() + rest.count() == 40_000
    assert some.where("own % 4 = 0").count() == 10_000 and some.count() < 14_000


def test_subsets_of_long_lists_leave_in_pieces(spark, monkeypatch):
    """Before, all subsets of a batch's lists were one array: beyond 2**31 of them, or the worker's memory, it failed."""
    monkeypatch.setattr(nj, "AT_ONCE", 400)
    lists = [(1, [3, 5, 8]), (2, list(range(90))), (3, [7]), (4, list(range(10, 75)))]
    df = spark.createDataFrame(lists, "key long, e array<long>").repartition(1)
    subsets = nj._subsets(df, 2)
    got = rows_of(subsets.select("key", "first").groupBy("key", "first").count())
    assert got == sorted([(k, x, len(e) - 1 - i) for k, e in lists for i, x in enumerate(e[:-1])], key=repr)
    assert subsets.distinct().count() == sum(len(e) * (len(e) - 1) // 2 for _, e in lists)
    three = nj._subsets(df, 3)
    assert three.where("key < 3").count() == three.where("key < 3").distinct().count() == 1 + 90 * 89 * 88 // 6


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)] + [(300 + rnd.randint(0, 60), 300 + rnd.randint(0, 60)) for _ in range(50)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.k: r.root for r in nj.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}
    assert nj.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hashing_is_as_words():
    texts = ["The quick, brown fox!", "a b", "", "x", "ÄÖ über Straße ok ok ok ok", "A1 a1 A1 a1 A1"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    rows, g = nj.gram_sets(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(grams(t)) for t in texts]


def test_rows_without_an_id_are_linked(spark):
    df = spark.createDataFrame([(None, "same words here and there", "", "", 1), (4, "same words here and there", "", "", 1)], SCHEMA)
    assert rows_of(nj.classes(df)) == [(4, 4, 1), (None, 4, 1)]
    assert rows_of(nj.one_of_each(df).select("doc_id")) == [(None,)]
    assert nj.one_of_each(df.where("doc_id = 4").unionByName(df.where("doc_id = 4"))).count() == 1


def test_sets_with_one_common_n_gram(spark):
    """A set of one n-gram and one of two are of similarity 0.5."""
    rows = [(1, "a b c", "", "", 1), (2, "a b c d", "", "", 1), (3, "z a b c", "", "", 1), (4, "a b c d e", "", "", 1), (5, "a b", "", "", 1)]
    assert rows_of(nj.classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("t", [0.35, 0.8])
def test_other_thresholds(spark, t):
    rows = near_copies(7, 6) + [(900 + i, " ".join("abcdefgh"[i % 3 : i % 3 + n]), "", "", 1) for i, n in enumerate((1, 2, 3, 4, 5, 6, 4, 5))]
    rows += [(950 + i, " ".join("abcdefgh"[i : i + 4 + i % 2]), "", "", 1) for i in range(4)]
    assert rows_of(nj.classes(frame(spark, rows), t=t)) == brute(rows, t)


def test_buckets_of_ngrams_have_a_bound_with_copies(spark, monkeypatch):
    # each copy's n-grams go to the buckets, if a batch has no other of the same text
    texts = [" ".join(f"t{i}w{j}" for j in range(402)) for i in range(10)]
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = spark.range(0, 8, 1, 8).crossJoin(F.broadcast(once)).select((F.col("id") * 100 + F.col("doc_id")).alias("doc_id"), "text")
    most = []
    live = nj._live

    def counted(postings, *bits):
        most.append(postings.groupBy("p").agg(F.sum(F.length("blob")).alias("n")).agg(F.max("n")).first()[0])
        return live(postings, *bits)

    monkeypatch.setattr(nj, "_live", counted)
    monkeypatch.setattr(nj, "PER_BUCKET", 1_000)
    _, sets = nj.linked(docs)
    assert sorted(r.links for r in sets.collect()) == [7] * 10
    assert most[0] < 3 * 6 * nj.PER_BUCKET
