import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_helpers import SCHEMA, messy_rows, prose, rows_of
from lodeseek.llm import mixing


def tokens(text):
    return re.findall(r"[^ \t\n\r]+", text or "")


def domain(source):
    m = re.search(r"([0-9]{1,9})$", source or "")
    return ["web", "reference", "forum", "books"][int(m[1]) % 4] if m else "other"


def share(nodes, given):
    """nodes: name -> (cap, weight). A full child's rest goes to its siblings, by weight."""
    alloc, left, open_ = {}, given, sorted(nodes, key=lambda n: (nodes[n][0] / nodes[n][1] if nodes[n][1] else float("inf"), n))
    while open_:
        cap, w = nodes[open_[0]]
        total = sum(nodes[n][1] for n in open_)
        if w and cap * total <= left * w:
            alloc[open_.pop(0)] = cap
            left -= cap
        else:
            return alloc | {n: left * nodes[n][1] // total if nodes[n][1] else 0 for n in open_}
    return alloc


def brute_budget(leaves, percent, epochs, domains, langs):
    def weight(level, name):
        return [domains.get(name, domains["other"] if level == 0 else 0), langs.get(name, mixing.LANG), mixing.SOURCE][level] if level != 0 else domains.get(name, domains["other"])

    cap = {leaf: n * epochs if all(weight(i, leaf[i]) > 0 for i in range(3)) else 0 for leaf, n in leaves.items()}
    given = {(): min(sum(leaves.values()) * percent // 100, sum(cap.values()))}
    for level in range(3):
        below = {}
        for parent, own in given.items():
            children = defaultdict(int)
            for leaf in leaves:
                if leaf[:level] == parent:
                    children[leaf[: level + 1]] += cap[leaf]
            below |= share({c: (n, weight(level, c[level])) for c, n in children.items()}, own)
        given = below
    return given


def brute(rows, percent=mixing.BUDGET_PERCENT, epochs=mixing.MAX_EPOCHS):
    """(doc_id, domain, epoch, tokens, taken) of what is read, each as often as it is."""
    leaf = lambda r: (domain(r[3]), r[2] if r[2] is not None else mixing.NONE, r[3] if r[3] is not None else mixing.NONE)
    own = defaultdict(list)
    for r in rows:
        if tokens(r[1]):
            own[leaf(r)].append((r[0], len(tokens(r[1])), r[1]))
    leaves = {k: sum(n for _, n, _ in v) for k, v in own.items()}
    out = []
    for k, alloc in brute_budget(leaves, percent, epochs, mixing.DOMAINS, mixing.LANGS).items():
        full, rest = divmod(alloc, leaves[k])
        out += [(i, k[0], e, n, n) for e in range(1, full + 1) for i, n, _ in own[k]]
        place = lambda x: (hashlib.md5(f"{mixing.SEED}:{full + 1}:{mixing.NONE if x[0] is None else x[0]}|{hashlib.md5(x[2].encode()).hexdigest()}".encode()).hexdigest(), x[1])  # noqa: B023, E731
        for i, n, _ in sorted(own[k], key=place):
            if rest <= 0:
                break
            out.append((i, k[0], full + 1, n, min(n, rest)))
            rest -= n
    return Counter(out)


def reads(df, **how):
    return Counter(tuple(r) for r in mixing.mixed(df, **how).select("row.doc_id", "domain", "epoch", "t", "take").collect())


@pytest.mark.parametrize(("percent", "epochs"), [(80, 4), (35, 1), (300, 4), (1000, 2), (0, 4)])
def test_as_by_hand(spark, messy, percent, epochs):
    assert reads(messy, percent=percent, max_epochs=epochs) == brute(messy_rows(), percent, epochs)


def test_many_sources(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(1, 40)), rnd.choice(["en", "de", "fr", "es", "it"]), f"src{int(rnd.paretovariate(0.7)) % 23}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = reads(df)
    assert got == brute(rows)
    total = sum(len(tokens(r[1])) for r in rows)
    taken = sum(k[4] * n for k, n in got.items())
    assert total * 0.8 - 100 < taken <= total * 0.8


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # web/de has nearly nothing: web/en takes what it can't, and reference gets no more than its own share
    leaves = spark.createDataFrame([("web", "en", "s0", 1000), ("web", "de", "s4", 1), ("reference", "en", "s1", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.alloc for r in mixing.budget(leaves, total=650, max_epochs=1).collect()}
    assert got == {("web", "de"): 1, ("web", "en"): 399, ("reference", "en"): 250}
    # once all of web is full, the rest goes up
    got = {(r.domain, r.lang): r.alloc for r in mixing.budget(leaves, total=1900, max_epochs=1).collect()}
    assert got == {("web", "de"): 1, ("web", "en"): 1000, ("reference", "en"): 899}


def test_weights_of_zero_get_nothing(spark):
    leaves = spark.createDataFrame([("web", "en", "s0", 100), ("forum", "en", "s2", 100)], "domain string, lang string, source string, tokens long")
    got = {r.domain: r.alloc for r in mixing.budget(leaves, total=150, domains={"web": 0, "other": 0, "forum": 1}).collect()}
    assert got == {"web": 0, "forum": 150}


def test_rows_of_the_stage(spark, messy, clashing, empty):
    out = mixing.mix(messy)
    assert out.columns == messy.columns and dict(out.dtypes) == dict(messy.dtypes)
    texts = {(r.doc_id, r.text) for r in messy.collect()}
    short = [r for r in out.collect() if (r.doc_id, r.text) not in texts]
    assert all(r.n_chars == len(r.text) for r in short)
    assert sum(len(tokens(r.text)) for r in out.collect()) == sum(k[4] * n for k, n in brute(messy_rows()).items())
    again = mixing.mix(clashing)
    assert again.columns == clashing.columns and rows_of(again.select(*messy.columns)) == rows_of(out)
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    assert mixing.mix(messy.where(F.col("text").isNull() | (F.trim("text") == ""))).count() == 0


def test_the_order_of_the_rows_makes_no_difference(spark):
    rows = [(7, f"w{i} a b c", "en", "src0", i) for i in range(12)] + [(None, f"v{i} a b c", "en", "src0", i) for i in range(12)] + [(8, "the same text", "en", "src0", i) for i in range(6)]
    one, other = (rows_of(mixing.mix(spark.createDataFrame(r, SCHEMA).coalesce(1))) for r in (rows, rows[::-1]))
    assert one == other and 0 < len(one) < len(rows)
