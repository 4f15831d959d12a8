import random
import re
from collections import defaultdict

import pytest

from llm_helpers import SCHEMA, messy_rows, rows_of
from lodeseek.llm import packing


def brute(lengths, capacity):
    """The rule on a plain list, without counts or masks; lengths of bins."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fits := [n for n in left if n <= gap]:
            own.append(max(fits))
            left.remove(max(fits))
            gap -= max(fits)
        if gap and left:
            small = min(own)
            room = gap + small
            best = max(((a + b, a) for i, a in enumerate(left) for b in left[:i] if a + b <= room), default=(0, 0))
            if best[0] > small:
                own.remove(small)
                own += [best[1], best[0] - best[1]]
                for n in own[-2:]:
                    left.remove(n)
                left = sorted([*left, small])
        bins.append(sorted(own))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_as_by_hand(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 50, 200])
    lengths = [rnd.choice([rnd.randint(1, capacity), rnd.randint(1, max(1, capacity // 5))]) for _ in range(rnd.randint(0, 60))]
    got = packing.pack(lengths, capacity)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in got)
    assert [sorted(lengths[i] for i in b) for b in got] == brute(lengths, capacity)


def test_replacement_fills_the_gap():
    # greedy puts 6 and 3 together; 2 and 2 fill the bin where 3 left a gap
    assert [sorted([6, 3, 2, 2][i] for i in b) for b in packing.pack([6, 3, 2, 2], 10)] == [[2, 2, 6], [3]]


def pieces_hold(rows, got, capacity):
    expect = defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^ \t\n\r]+", r[1] or ""))
        if n:
            expect[r[0]] += n
    taken, bins, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    for doc, b, slot, start, n in got:
        taken[doc] += n
        bins[b] += n
        slots[b].append(slot)
        assert 1 <= n <= capacity and start % capacity == 0
    assert taken == expect
    assert all(n <= capacity for n in bins.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("group", [7, 20_000])
def test_messy(spark, messy, clashing, group):
    got = rows_of(packing.packed(messy, capacity=64, group=group))
    pieces_hold(messy_rows(), got, 64)
    assert rows_of(packing.packed(clashing, capacity=64, group=group)) == got
    assert rows_of(packing.packed(messy.repartition(5), capacity=64, group=group)) == got


def test_large_ids_beside_null_ones(spark):
    rows = [(2**60 + i, "a b c", "", "", 1) for i in range(5)] + [(None, "a b c", "", "", 1)]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id for r in got.collect()} == {None, *[2**60 + i for i in range(5)]}


def test_other_ids_and_many_copies(spark):
    rows = [(f"d{i % 3}", "a b c") for i in range(60)] + [(None, "a b c d")] * 5
    got = [tuple(r) for r in packing.packed(spark.createDataFrame(rows, "doc_id string, text string"), capacity=10, group=10).collect()]
    pieces_hold(rows, got, 10)
    assert len({b.split("-")[0] for _, b, *_ in got}) > 4


def test_one_group_is_as_pack(spark):
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 40) for _ in range(200)]
    df = spark.createDataFrame([(i, "w " * n, "", "", 1) for i, n in enumerate(lengths)], SCHEMA)
    bins = defaultdict(list)
    for r in packing.packed(df, capacity=50).collect():
        bins[r.bin].append(r.n_tokens)
    full = [n for n in lengths if n < 50]
    assert sorted(sorted(b) for b in bins.values()) == sorted(brute(full, 50))


def test_empty(spark, empty):
    assert packing.packed(empty).count() == 0
    assert packing.packed(spark.createDataFrame([(1, "", "", "", 1), (2, None, "", "", 1)], SCHEMA)).count() == 0
