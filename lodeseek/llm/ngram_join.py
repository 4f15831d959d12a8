"""N-gram Jaccard self-join: an exact size-aware heavy-light join over groups of like n-gram sets.

A document is the set of its word N-grams, as 48-bit hashes. Rows of one and the same set are one from the
first step on. The steps:

1. Document frequencies. The n-grams of all sets go, packed, to buckets of their hash, which find those that two
   sets or more hold (live). N-grams that many rows of one batch hold are known beforehand, are live, and skip the
   buckets, so that none of these has to hold all sets of such an n-gram.
2. Prefixes. Live n-grams come back to their sets. A set of n n-grams of which fewer than T * n are live has no
   partner. Of the others, by (frequency, hash), the first L - ceil(T * n) + C of the L live ones are the prefix: two
   sets of similarity T share C elements of their prefixes. Nothing is drawn, so nothing is lost here.
3. Groups. Sets go in one group by the min-hash of their prefix: near copies mostly share it, so that thousands of
   them are one side of the join. The union of its members' prefixes stands for the group.
4. Heavy-light join of groups that share C elements. Light groups (at most x elements that other groups have too) emit
   each C-subset, and meet where one is the same; heavy ones scan the inverted lists of their elements over all
   groups, and count. x is the boundary of least estimated cost. Sets so small that they can be of similarity T
   with fewer than C common elements are joined by each element.
5. Cells. Each group is a home, in blocks; the members of the smaller group of a pair visit the blocks of the larger
   one, and a block is visited by those before it. A cell counts the common n-grams of its block with all that visit it,
   by sparse or dense products, and returns sums and one link for each set: pairs are never written.

Sets are told apart by a 64-bit print (two of s sets have the same one with a probability of s**2 / 3.7e19).
"""

from __future__ import annotations

from itertools import chain, combinations, islice
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import table, written
from lodeseek.llm.textfeat import _LOWER, _WORD, _power_tables, buffers, chunks

#: Words of an n-gram; the similarity from which documents are linked; size of the subsets.
N, T, C = 3, 0.5, 2
#: An n-gram in more than one of so many rows that are read at once, and of all rows, and in LEAST_HOT of the former, skips the buckets.
HOT, LEAST_HOT = 256, 32
#: N-grams of a bucket, about, and those packed at once; live n-grams of a bucket of sets.
PER_BUCKET, AT_ONCE, PER_SETS = 1_000_000, 600_000, 500_000
#: Elements and sets of a block, sets that visit a cell, about.
BLOCK, MEMBERS, VISITS = 1 << 19, 512, 16_384
#: Keys are sent to all executors up to so many, some 40 MB, of which two are built at once in the driver; of more of them a bitmap is.
FEW = 250_000
#: Bits of a bitmap for each key, and at most (2**MOST_BITS, 32 MB): more keys let more rows through that are none of them.
KEY_BITS, MOST_BITS = 16, 28
#: Shuffled rows of a subset and of a posting cost about the same; a scanned list element costs this much of one.
SCAN_COST = 0.5
#: Nanoseconds of one common n-gram of a sparse product, and of one cell of a dense one.
SPARSE_NS, DENSE_NS = 12.0, 0.1

_G = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 48) - 1)
#: Frequency by which n-grams that skip the buckets are ordered: last.
_LAST = 65_535


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit hash) of the distinct word n-grams of each row, sorted. off starts at 0.

    A word is a run of ASCII letters, digits and non-ASCII characters, with ASCII letters lowered. A text of
    fewer than n words, one at least, has one n-gram: all its words.
    """
    low = _LOWER[data]
    size = len(low)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _WORD[low]
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    first = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:-1]))
    last = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1
    up, down = _power_tables(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    words = _mix((total[last] - total[first]) * down[first])
    w0 = np.searchsorted(first, off)
    count = np.diff(w0)
    row_of = np.repeat(np.arange(len(count)), count)
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            h = h * _G + words[j : len(words) - n + 1 + j]
        inside = row_of[: len(h)] == row_of[n - 1 :]
        grams, rows = h[inside], row_of[: len(h)][inside]
    else:
        grams, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for r in short:
            h = np.uint64(count[r])
            with np.errstate(over="ignore"):
                for x in words[w0[r] : w0[r + 1]]:
                    h = h * _G + x
            own.append(h)
        grams, rows = np.concatenate([grams, np.asarray(own, np.uint64)]), np.concatenate([rows, short])
    both = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (_mix(grams) & _MASK))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> np.uint64(48)).astype(np.int64), both & _MASK


def _runs(off: np.ndarray):
    """chunks(), of at most 65,535 rows: a row's number takes 16 bits beside the hash."""
    for i, j in chunks(off, 1 << 18):
        for k in range(i, j, 65_535):
            yield k, min(j, k + 65_535)


def pack48(x: np.ndarray) -> bytes:
    """Numbers under 2**48 in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b) -> np.ndarray:
    six = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _blob(sids: np.ndarray, g: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """Postings, those of a set in a row: the sets and their counts, the n-grams, and their frequencies if given."""
    first = np.flatnonzero(np.concatenate(([True], sids[1:] != sids[:-1])))
    count = np.diff(np.concatenate((first, [len(sids)]))).astype(np.uint32)
    return b"".join((np.asarray([len(first), len(g)], np.int64).tobytes(), sids[first].tobytes(), count.tobytes(), pack48(g), b"" if df is None else df.astype(np.uint16).tobytes()))


def _unblob(blobs: list, with_df: bool) -> list[np.ndarray]:
    """(sets, n-grams, frequencies) of all postings of the blobs."""
    out: list = [[], [], []]
    for b in blobs:
        k, p = np.frombuffer(b, np.int64, 2)
        at = 16 + 12 * k
        out[0].append(np.repeat(np.frombuffer(b, np.uint64, k, 16), np.frombuffer(b, np.uint32, k, 16 + 8 * k)))
        out[1].append(unpack48(memoryview(b)[at : at + 6 * p]))
        out[2].append(np.frombuffer(b, np.uint16, p, at + 6 * p) if with_df else np.zeros(0, np.uint16))
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.uint64, np.uint64, np.uint16))]


def _hashed(texts: pa.Array, n: int):
    """For runs of rows: (first row, n-grams of each, row of each n-gram, n-grams)."""
    data, off = buffers(texts)
    for i, j in _runs(off):
        rows, g = gram_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
        yield i, np.bincount(rows, minlength=j - i), rows, g


def _prints(count: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit prints of each set."""
    at, out = np.concatenate(([0], np.cumsum(count))), []
    for salt in (1, 2):
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(_mix(g + np.uint64(salt << 50)), out=total[1:])
        out.append(_mix((total[at[1:]] - total[at[:-1]]) ^ (count.astype(np.uint64) << np.uint64(40))))
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted x, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))), [len(x)])) if len(x) else np.zeros(1, np.int64)


def _hot(grams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that stand in least rows or more, and in how many. Only those of full slots of a table are sorted."""
    slot = lambda g: (g & np.uint64((1 << 20) - 1)).astype(np.int64)
    full = np.zeros(1 << 20, np.int64)
    for g in grams:
        full += np.bincount(slot(g), minlength=1 << 20)
    full = full >= least
    g = np.sort(np.concatenate([g[full[slot(g)]] for g in grams]))
    at = _starts(g)
    many = np.diff(at) >= least
    return g[at[:-1][many]], np.diff(at)[many]


def row_key(df: DataFrame):
    """128 bits for rows of one id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.length(F.col("doc_id").cast("string")), F.lit(-1)).cast("string"), F.col("doc_id").cast("string"), "text").cast("binary")))


def signatures(docs: DataFrame, n: int = N) -> tuple[DataFrame, list[int]]:
    """(doc_id, k, n, sid, f2) of each row: its key, and the size and prints of its set; and n-grams that very many rows hold."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sweep(batches):
        for b in batches:
            parts: list = [[], [], []]
            grams, held, rows = [], 0, 0
            kinds = [b.column("doc_id").type, b.column("k").type, pa.int32(), pa.int64(), pa.int64()]
            for at, count, _, g in _hashed(b.column("text"), n):
                for part, x in zip(parts, (count, *_prints(count, g))):
                    part.append(x)
                grams, held, rows = [*grams, g], held + len(g), rows + len(count)
                if held >= AT_ONCE or at + len(count) == len(b):
                    hot_g, many = _hot(grams, max(LEAST_HOT, rows // HOT))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(hot_g), k) for k in kinds), pa.array(hot_g.view(np.int64)), pa.array(many)], names)
                    grams, held, rows = [], 0, 0
            if parts[0]:
                size, f1, f2 = (np.concatenate(p) for p in parts)
                cols = [b.column("doc_id"), b.column("k"), pa.array(size.astype(np.int32)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names)

    names = ["doc_id", "k", "n", "sid", "f2", "g", "rows"]
    both = written(docs.select("doc_id", row_key(docs).alias("k"), "text").mapInArrow(sweep, f"doc_id {kind}, k binary, n int, sid long, f2 long, g long, rows long"))
    sig = both.where("n is not null").drop("g", "rows")
    # at most HOT times a set's n-grams
    hot = both.where("g is not null").groupBy("g").agg(F.sum("rows").alias("rows")).where(F.col("rows") * HOT >= sig.count()).select("g").collect()
    return sig, sorted(r.g for r in hot)


def _sweep_buckets(batches, key: str, done):
    """Runs done(key, batches' rows) for each run of equal keys; batches are sorted by it."""
    at, held = None, []
    for b in batches:
        keys = b.column(key).to_numpy()
        cut = _starts(keys)
        for x, y in zip(cut[:-1], cut[1:]):
            if keys[x] != at and held:
                yield from done(at, held)
                held = []
            at = keys[x]
            held.append(b.slice(x, y - x))
    if held:
        yield from done(at, held)


def _rows(held: list, name: str) -> list:
    return [v for b in held for v in b.column(name).to_pylist()]


def _scatter(docs: DataFrame, n: int, bits: int, hot: list[int]) -> DataFrame:
    """(p, blob): postings of the sets of docs by buckets of the n-gram's hash; those of hot ones by the set, from bucket 2**bits on."""
    hot_g = np.asarray(hot, np.uint64)

    def flush(sids, counts, grams):
        sid, count, g = np.concatenate(sids), np.concatenate(counts), np.concatenate(grams)
        _, first = np.unique(sid, return_index=True)
        own = np.zeros(len(sid), bool)
        own[first] = True
        g, sid = g[np.repeat(own, count)], np.repeat(sid[own], count[own])
        p = (g >> np.uint64(48 - bits)).astype(np.int64)
        if len(hot_g):
            is_hot = hot_g[np.minimum(np.searchsorted(hot_g, g), len(hot_g) - 1)] == g
            p[is_hot] = (1 << bits) + (sid[is_hot] & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(p.astype(np.uint16) if bits < 15 else p, kind="stable")
        p, sid, g = p[order], sid[order], g[order]
        cut = _starts(p)
        yield pa.RecordBatch.from_arrays([pa.array(p[cut[:-1]].astype(np.int32)), pa.array([_blob(sid[x:y], g[x:y]) for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["p", "blob"])

    def sweep(batches):
        held: list = [[], [], []]
        size = 0
        for b in batches:
            for _, count, _, g in _hashed(b.column("text"), n):
                for part, x in zip(held, (_prints(count, g)[0], count, g)):
                    part.append(x)
                size += len(g)
                if size >= AT_ONCE:
                    yield from flush(*held)
                    held, size = [[], [], []], 0
        if size:
            yield from flush(*held)

    return docs.select("text").mapInArrow(sweep, "p int, blob binary")


def _live(postings: DataFrame, bits: int, set_bits: int) -> DataFrame:
    """(q, blob): of each bucket the postings of n-grams of two sets or more, with their frequency, by buckets of the sets."""

    def done(p, held):
        sid, g, _ = _unblob(_rows(held, "blob"), False)
        order = np.lexsort((sid, g))
        sid, g = sid[order], g[order]
        # one set may come from several batches
        once = np.concatenate(([True], (g[1:] != g[:-1]) | (sid[1:] != sid[:-1])))
        sid, g = sid[once], g[once]
        df = np.repeat(np.diff(_starts(g)), np.diff(_starts(g)))
        df = np.full(len(g), _LAST) if p >= 1 << bits else np.minimum(df, _LAST - 1)
        sid, g, df = sid[df > 1], g[df > 1], df[df > 1]
        q = (sid & np.uint64((1 << set_bits) - 1)).astype(np.int64)
        order = np.lexsort((sid, q))
        q, sid, g, df = q[order], sid[order], g[order], df[order]
        cut = _starts(q)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q[cut[:-1]].astype(np.int32)), pa.array([_blob(sid[x:y], g[x:y], df[x:y]) for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["q", "blob"])

    return postings.repartition("p").sortWithinPartitions("p").mapInArrow(lambda batches: _sweep_buckets(batches, "p", done), "q int, blob binary")


def _both(t: float, c: int) -> int:
    """n-grams of two sets together, up to which they can be of similarity t with fewer than c in common: o common ones allow o * (1 + 1 / t)."""
    return int((c - 1) * (1 + 1 / t) + 1e-9)


def _prefixes(live: DataFrame, sets: DataFrame, set_bits: int, t: float, c: int) -> DataFrame:
    """(sid, n, w, key, g, prefix) of the sets that can have a partner: their live n-grams, prefix and its min-hash."""

    def done(q, held):
        sid, n, w = (np.asarray([v for v in _rows(held, x) if v is not None], np.int64) for x in ("sid", "n", "w"))
        order = np.argsort(sid.view(np.uint64))
        sid, n, w = sid.view(np.uint64)[order], n[order], w[order]
        own, g, df = _unblob([v for v in _rows(held, "blob") if v is not None], True)
        order = np.lexsort((g, df, own))
        own, g = own[order], g[order]
        cut = _starts(own)
        at = np.searchsorted(sid, own[cut[:-1]])
        out: list = [[] for _ in range(6)]
        for i, x, y in zip(at, cut[:-1], cut[1:]):
            least = ceil(t * n[i] - 1e-9)
            if y - x < least:
                continue
            take = y - x if n[i] < _both(t, c) else min(y - x, y - x - least + c)
            prefix = g[x : x + take]
            for part, v in zip(out, (sid[i], n[i], w[i], _mix(prefix).min(), pack48(np.sort(g[x:y])), prefix.view(np.int64))):
                part.append(v)
        if out[0]:
            longs = [pa.array(np.asarray(v).astype(np.uint64).view(np.int64)) for v in out[:4]]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.int64()))], ["sid", "n", "w", "key", "g", "prefix"])

    none = F.lit(None)
    q = F.col("sid").bitwiseAND(F.lit((1 << set_bits) - 1)).cast("int").alias("q")
    rows = live.select("q", none.cast("long").alias("sid"), none.cast("long").alias("n"), none.cast("long").alias("w"), "blob").unionByName(sets.select(q, "sid", F.col("n").cast("long"), "w", none.cast("binary").alias("blob")))
    return rows.repartition("q").sortWithinPartitions("q").mapInArrow(lambda batches: _sweep_buckets(batches, "q", done), "sid long, n long, w long, key long, g binary, prefix array<long>")


def _subsets(lists: DataFrame, c: int) -> DataFrame:
    """(key, first, more): each c-subset of each list e: its first element, and a hash of the others. Lists are in one order of all elements.

    They leave by AT_ONCE at most, however long the lists are.
    """

    def picks(q):
        """Runs of the c-subsets of q places."""
        every = combinations(range(q), c)
        while len(x := np.fromiter(chain.from_iterable(islice(every, AT_ONCE // 4)), np.int64)):
            yield x.reshape(-1, c)

    def sweep(batches):
        index: dict = {}

        def batch(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["key", "first", "more"])

        held: list = [[], [], []]
        size = 0
        for b in batches:
            e = b.column("e")
            off, flat = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, key in enumerate(b.column("key").to_numpy()):
                own = flat[off[i] : off[i + 1]]
                q = len(own)
                if q not in index and q <= 64:  # longer ones would fill the worker's memory
                    index[q] = list(picks(q))
                for at in index[q] if q in index else picks(q):
                    if held[0] and size + len(at) > AT_ONCE:
                        yield batch(held)
                        held, size = [[], [], []], 0
                    h = np.zeros(len(at), np.uint64)
                    for k in range(1, c):
                        h = _mix(h * _G + own[at[:, k]])
                    for part, x in zip(held, (np.full(len(at), key), own[at[:, 0]].view(np.int64), h.view(np.int64))):
                        part.append(x)
                    size += len(at)
        if size:
            yield batch(held)

    return lists.select("key", "e").mapInArrow(sweep, "key long, first long, more long")


def _group_pairs(prefixes: DataFrame, groups: DataFrame, t: float, c: int) -> DataFrame:
    """(a, b) distinct, a < b: keys of the groups that can hold partners of each other."""
    own = prefixes.select("key", F.explode("prefix").alias("g")).distinct()
    lists = own.groupBy("g").agg(F.count("*").alias("groups")).where("groups > 1")
    posts = written(own.join(lists, "g"))
    sizes = written(posts.groupBy("key").agg(F.count("*").alias("size"), F.sum("groups").alias("scan")).where(F.col("size") >= c))
    x = boundary([(r.size, r.sets, float(r.scan)) for r in sizes.groupBy("size").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()], c)
    posts = posts.drop("groups").join(sizes.select("key", (F.col("size") <= x).alias("light")), "key")
    keys = _subsets(posts.where("light").groupBy("key").agg(F.sort_array(F.collect_list("g")).alias("e")), c)
    met = keys.select("first", F.col("key").alias("a"), F.col("more").alias("m")).join(keys.select("first", F.col("key").alias("b"), F.col("more").alias("m")), ["first", "m"]).where("a < b").select("a", "b")
    heavy, every = posts.where("not light").select(F.col("key").alias("u"), "g"), posts.select(F.col("key").alias("v"), "g", "light")
    scanned = heavy.join(every, "g").where("u != v and (light or u < v)").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).count().where(F.col("count") >= c).select("a", "b")
    # sets that can be of similarity t with fewer than c common elements
    both = _both(t, c)
    tiny = prefixes.where(f"n < {both}").select("key", "n", F.explode("prefix").alias("g"))
    small = tiny.where(f"n <= {both // 2}").select(F.col("key").alias("u"), F.col("n").alias("m"), "g").join(tiny, "g").where(f"u != key and m + n <= {both}").select(F.least("u", "key").alias("a"), F.greatest("u", "key").alias("b"))
    found = met.unionByName(scanned).unionByName(small).distinct()
    for side in ("a", "b"):
        found = found.join(groups.select(F.col("key").alias(side), F.struct("key", "sets", "low", "high").alias(f"g_{side}")), side)
    return found.where((F.col("g_a.high") >= t * F.col("g_b.low")) & (F.col("g_b.high") >= t * F.col("g_a.low"))).select("g_a", "g_b")


def _common(own: tuple, rows: np.ndarray, g: np.ndarray, v: int) -> np.ndarray:
    """Numbers of common n-grams of a block's sets (lines) and v others (columns), whose postings are (rows, g).

    own: (number of sets, distinct n-grams of the block, where the sets of each begin, these sets).
    """
    u, words, at, sets = own
    out = np.zeros(u * v, np.int64)
    if not len(words) or not len(g):
        return out.reshape(u, v)
    col = np.minimum(np.searchsorted(words, g), len(words) - 1)
    hit = words[col] == g
    col, rows = col[hit], rows[hit]
    reps = at[col + 1] - at[col]
    used = np.unique(col)
    if SPARSE_NS * reps.sum() <= DENSE_NS * u * v * len(used):
        ends = np.cumsum(reps)
        a = 0
        while a < len(col):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 19), "right")))
            r = reps[a:b]
            begin = np.repeat(at[col[a:b]] - (np.cumsum(r) - r), r)
            line = sets[begin + np.arange(r.sum())]
            out += np.bincount(line * v + np.repeat(rows[a:b], r), minlength=u * v)
            a = b
        return out.reshape(u, v)
    total = np.zeros((u, v), np.float32)
    order = np.argsort(col, kind="stable")
    col, rows = col[order], rows[order]
    step = max(1, (1 << 21) // (u + v))
    for i in range(0, len(used), step):
        some = used[i : i + step]
        left, right = np.zeros((u, len(some)), np.float32), np.zeros((len(some), v), np.float32)
        r = at[some + 1] - at[some]
        left[sets[np.repeat(at[some] - (np.cumsum(r) - r), r) + np.arange(r.sum())], np.repeat(np.arange(len(some)), r)] = 1
        x, y = np.searchsorted(col, some[0]), np.searchsorted(col, some[-1], "right")
        right[np.searchsorted(some, col[x:y]), rows[x:y]] = 1
        total += left @ right
    return total.astype(np.int64)


class _Cell:
    """A block of sets, the links found of each, and its parts that are known to be connected."""

    def __init__(self, sid, n, w, g, first: bool, t: float):
        self.sid, self.n, self.w, self.t = sid, n, w, t
        flat = np.concatenate([unpack48(x) for x in g]) if g else np.zeros(0, np.uint64)
        line = np.repeat(np.arange(len(g)), [len(x) // 6 for x in g])
        order = np.argsort(flat, kind="stable")
        at = _starts(flat[order])
        self.own = (len(g), flat[order][at[:-1]], at, line[order])
        self.links, self.part = np.zeros(len(g), np.int64), np.arange(len(g))
        if first:
            linked = self._linked(_common(self.own, line, flat, len(g)), n)
            np.fill_diagonal(linked, True)
            self.links += linked @ w - w
            self._connect(linked)

    def _linked(self, common, n):
        union = self.n[:, None] + n[None, :] - common
        return (common > 0) & (common >= self.t * union - 1e-9)

    def _connect(self, linked):
        """Lets what is linked be of one part: the least of both, until nothing changes."""
        u = len(self.part)
        if not u or not linked.any():
            return
        while True:
            of = np.where(linked, self.part[:, None], u).min(0)
            low = np.minimum(self.part, np.where(linked, of[None, :], u).min(1))
            least = np.full(u, u)
            np.minimum.at(least, self.part, low)
            new = least[self.part]
            if (new == self.part).all():
                return
            self.part = new

    def visit(self, sid, n, w, g):
        """Of those visitors that have links: (sid, links, a set of the block that each is connected with)."""
        if not len(self.sid):  # a block may have got no set of its group
            return (np.zeros(0, np.int64),) * 3
        flat = np.concatenate([unpack48(x) for x in g])
        linked = self._linked(_common(self.own, np.repeat(np.arange(len(g)), [len(x) // 6 for x in g]), flat, len(g)), n)
        self.links += linked @ w
        self._connect(linked)
        any_of = linked.any(0)
        return sid[any_of], (self.w @ linked)[any_of], self.sid[self.part[linked.argmax(0)[any_of]]]

    def end(self):
        found = self.links > 0
        return self.sid[found], self.links[found], self.sid[self.part[found]]


def _cells(prefixes: DataFrame, groups: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(sid, links, other): number of rows of other sets that are linked with a set, in a cell, and a set that it is connected with."""
    a_home = (F.col("g_a.sets") > F.col("g_b.sets")) | ((F.col("g_a.sets") == F.col("g_b.sets")) & (F.col("g_a.key") < F.col("g_b.key")))
    sides = written(pairs.select(F.when(a_home, F.col("g_a")).otherwise(F.col("g_b")).alias("home"), F.when(a_home, F.col("g_b")).otherwise(F.col("g_a")).alias("guest")).select(F.col("home.key").alias("home"), F.col("guest.key").alias("key"), F.col("guest.sets").alias("guests")))
    came = sides.groupBy(F.col("home").alias("key")).agg(F.sum("guests").alias("guests"))
    blocks = F.greatest(F.ceil(F.col("elements") / BLOCK), F.ceil(F.col("sets") / MEMBERS)).cast("int").alias("blocks")
    homes = groups.join(came, "key", "left").where("sets > 1 or guests is not null").select("key", blocks, F.ceil(F.greatest(F.lit(1), (F.coalesce("guests", F.lit(0)) + F.col("sets")) / VISITS)).cast("int").alias("parts"))
    homes = written(homes)
    of = lambda count: F.pmod(F.xxhash64("sid"), F.col(count)).cast("int")
    body = ["sid", "n", "w", "g"]
    own = prefixes.select("key", *body).join(homes, "key").withColumn("block", of("blocks"))
    members = own.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("tag"), *body)
    visitor = lambda home, block: (F.col(home).alias("key"), F.explode(block).alias("block"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("tag"), *body)
    later = own.where("block + 1 < blocks").select(*visitor("key", F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    to = sides.select("home", "key").join(homes.select(F.col("key").alias("home"), "blocks", "parts"), "home")
    guests = prefixes.select("key", *body).join(to, "key").select(*visitor("home", F.sequence(F.lit(0), F.col("blocks") - 1)))
    line = members.unionByName(later).unionByName(guests)

    def batch(sid, links, other):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (sid, links, other)], ["sid", "links", "other"])

    def sweep(batches):
        at, cell, held = None, None, []

        def opened():
            return _Cell(*(np.asarray([h[i] for h in held], np.int64) for i in range(3)), [h[3] for h in held], at[2] == 0, t)

        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("key", "block", "part"))))
            tag = b.column("tag").to_numpy()
            sid, n, w = (b.column(c).to_numpy() for c in ("sid", "n", "w"))
            g = b.column("g")
            i = 0
            while i < len(places):
                if places[i] != at:
                    if held:
                        cell = opened()
                    if cell is not None:
                        yield batch(*cell.end())
                    at, cell, held = places[i], None, []
                if not tag[i]:
                    held.append((sid[i], n[i], w[i], g[i].as_py()))
                    i += 1
                    continue
                if cell is None:
                    cell, held = opened(), []
                j, size = i, 0
                while j < len(places) and places[j] == at and j - i < MEMBERS and size < BLOCK:
                    size += len(g[j].as_buffer()) // 6
                    j += 1
                yield batch(*cell.visit(sid[i:j], n[i:j], w[i:j], [x.as_py() for x in g[i:j]]))
                i = j
        if held:
            cell = opened()
        if cell is not None:
            yield batch(*cell.end())

    return line.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "tag").mapInArrow(sweep, "sid long, links long, other long")


def boundary(costs: list[tuple[int, int, float]], c: int = C) -> int:
    """The size x up to which sets are light, of least estimated cost.

    costs: (size, number of sets, elements of all their inverted lists).
    """
    costs = sorted(costs)
    light, heavy = 0.0, sum(k * q + SCAN_COST * s for q, k, s in costs)
    best, x = heavy, 0
    for q, k, s in costs:
        light, heavy = light + float(k) * comb(q, c), heavy - (k * q + SCAN_COST * s)
        if light + heavy < best:
            best, x = light + heavy, q
    return x


def components(edges: DataFrame) -> DataFrame:
    """(k, root): the least node of the component of every node of edges (u, v), by large and small stars.

    Each round rewires every node to the least neighbour, from both sides, until nothing changes; rounds grow
    with the logarithm of the longest path. Each round is written, so no lineage builds up.
    """
    edges = written(edges.select("u", "v").where("u != v").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the neighbours that are not larger, and the node itself, to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("k"), F.col("v").alias("root"))
        last = now


def linked(docs: DataFrame, n: int = N, t: float = T, c: int = C) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): (doc_id, k, n, sid) of each row, and (sid, root, links) of each set that is linked or of several rows.

    links: the other rows, of its set or of another, whose sets are of similarity t or more. root: the same for all sets
    that links connect. n is 0, and sid without meaning, for a null or empty text and one without any word.
    """
    sig, hot = signatures(docs, n)
    sets = written(sig.where("n > 0").groupBy("n", "sid", "f2").agg(F.count("*").alias("w")))
    # copies from other batches go to the buckets too, and end there
    total, rows = (x or 0 for x in sets.agg(F.sum("n"), F.sum(F.col("n") * F.col("w"))).first())
    bits = min(30, max(1, ceil(np.log2(max(1, rows / PER_BUCKET)))))
    set_bits = min(30, max(1, ceil(np.log2(max(1, total / 4 / PER_SETS)))))
    live = _live(_scatter(docs, n, bits, hot), bits, set_bits)
    prefixes = written(_prefixes(live, sets, set_bits, t, c))
    groups = written(prefixes.groupBy("key").agg(F.count("*").alias("sets"), F.sum(F.length("g") / 6).alias("elements"), F.min("n").alias("low"), F.max("n").alias("high")))
    found = written(_cells(prefixes, groups, _group_pairs(prefixes, groups, t, c), t))
    near = found.groupBy("sid").agg(F.sum("links").alias("near"))
    roots = components(found.select(F.col("sid").alias("u"), F.col("other").alias("v")))
    more = sets.where("w > 1").select("sid", (F.col("w") - 1).alias("copies"))
    several = near.join(more, "sid", "full").join(roots.withColumnRenamed("k", "sid"), "sid", "left")
    return sig.drop("f2"), written(several.select("sid", F.coalesce("root", "sid").alias("root"), (F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("links")))


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, links), one row for each row of docs.

    links: how many other rows are of similarity T or more, copies and rows with the same doc_id too. class_id: the
    least doc_id of all rows that links connect with this one; its own if it has none. A null doc_id counts as a row but
    names no class, unless all are null. A null or empty text, or one without a word, has no n-gram and no link. doc_id may be of
    any type that can be ordered. Columns besides doc_id and text are not read.
    """
    rows, sets = linked(docs, **how)
    known = rows.where("n > 0").select("doc_id", "sid").join(sets, "sid")
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = sets.join(least, "root").select("sid", "class_id", "links")
    alone = F.when(F.col("n") > 0, F.col("sid"))
    out = rows.withColumn("sid", alone).join(named, "sid", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _once(rows: DataFrame, key: str, again: DataFrame) -> DataFrame:
    """rows with one row of each key. again: the keys that are there more than once, so that only those rows move."""
    same = F.col(key) == F.col("again")
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key]))


def _apart(rows: DataFrame, key: str, keys: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of keys, count of them about, and those whose key is none, by a bitmap of hashes."""
    bits = min(MOST_BITS, max(16, ceil(np.log2(KEY_BITS * max(1, count)))))
    h = F.xxhash64(F.lit(3), F.col(key)).bitwiseAND(F.lit((1 << bits) - 1))
    at, page = h.bitwiseAND(F.lit((1 << 15) - 1)), F.shiftright(h, 15)
    pages = written(keys.select(page.alias("page"), at.alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")))
    # at most 2**(MOST_BITS - 15) pages of 4 KB
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_one = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = rows.join(F.broadcast(pages), page == F.col("page"), "left").select(*rows.columns, is_one.alias("may"))
    return marked.where("may").drop("may"), marked.where("not may").drop("may")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one row of each class of classes(): the one of the least (doc_id, row_key) stays, null first.

    Of rows that are the same in id and text one stays, if they have any n-gram: any one, should they differ in other
    columns. Texts without a word stay as they are.
    """
    rows, sets = linked(docs, **how)
    known = rows.where("n > 0").join(sets, "sid").select("root", "k", F.struct("doc_id", "k").alias("row"))
    least = known.groupBy("root").agg(F.min("row").alias("stays"))
    goes = written(known.join(least, "root").where("k != stays.k").select(F.col("k").alias("own")).distinct())
    again = written(rows.where("n > 0").groupBy(F.col("k").alias("again")).count().where("count > 1").select("again"))
    # docs' columns go through as a struct: their names may be any
    whole = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), row_key(docs).alias("own"))
    many = goes.count(), again.count()
    if max(many) <= FEW:
        return _once(whole.join(F.broadcast(goes), "own", "left_anti"), "own", F.broadcast(again)).select("row.*")
    # too many for a broadcast: rows that may be meant move, and no others
    some, rest = _apart(whole, "own", goes.unionByName(again.withColumnRenamed("again", "own")), sum(many))
    return rest.unionByName(_once(some.join(goes, "own", "left_anti"), "own", again)).select("row.*")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
with recursive docs as (
  select row_number() over () as i, doc_id, coalesce(text, '') as text from documents
), words as (
  select i, regexp_extract_all(translate(text, {_LETTERS}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from docs
), sets as (
  select i, list_distinct(case when len(w) < {N} then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - {N} + 1), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) end) as s from words where len(w) > 0
), posts as (
  select i, len(s) as n, unnest(s) as g from sets
), pairs as (
  select a.i as a, b.i as b from posts a join posts b on a.g = b.g and a.i <> b.i
  group by a.i, b.i having count(*) >= {T} * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) as (
  select i, i from docs union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a
), named as (
  select reach.a, min(docs.doc_id) as class_id from reach join docs on reach.b = docs.i group by reach.a
), counted as (
  select a, count(*) as links from pairs group by a
)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(links, 0)::bigint as links
from docs join named on docs.i = named.a left join counted on docs.i = counted.a
"""
