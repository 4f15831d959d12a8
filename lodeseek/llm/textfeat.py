"""Hashed word and character n-grams of Arrow string batches, and logistic regression over them.

Texts never become Python strings: hashes are computed over the UTF-8 buffers of the batch with
vectorised arithmetic, a few bytes-per-nanosecond passes per n-gram family.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Hash buckets of each family are 2**BITS.
BITS = 18
#: Bytes of text hashed at once; bounds the worker's memory whatever the batch or text size.
CHUNK = 1 << 17
#: Values of sparse rows worked on at once in training; bounds the driver's memory.
BLOCK = 1 << 20
CHAR_NS = (3, 5)
FAMILIES = ("char3", "char5", "word1", "word2")
#: A feature's value is SCALE * count / (the document's n-grams of the family + DAMP): DAMP keeps a few words from saying much.
SCALE, DAMP = 40.0, 10.0

_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = 0x100000001B3
_P_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(10, int(n).bit_length())
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets (one more than rows); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if offs is not None and len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, size: int | None = None):
    """Runs of rows of at most size bytes, CHUNK by default (a longer text is a run by itself)."""
    i, n, size = 0, len(off) - 1, CHUNK if size is None else size
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1))) * _MUL
    h ^= h >> np.uint64(29)
    h *= _MUL
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def hashed(data: np.ndarray, off: np.ndarray):
    """For each family: (name, slots of all its n-grams in order, first n-gram of each row and the end).

    off starts at 0. Characters are bytes of the ASCII-lowered UTF-8 text. A word is a run of letters,
    digits and non-ASCII bytes. A word pair's hash is the difference of the words' hashes, so any word
    that is followed by itself falls in one bucket, which is how repetition shows.
    """
    low = _LOWER[data]
    n = len(low)
    starts, ends = off[:-1], off[1:]
    wide = low.astype(np.uint64)
    for k in CHAR_NS:
        if n >= k:
            h = wide[: n - k + 1].copy()
            for j in range(1, k):
                h = h * np.uint64(0x1003F) + wide[j : n - k + 1 + j]
            slots = _slot(h, k)
        else:
            slots = np.zeros(0, np.int32)
        yield f"char{k}", slots, starts, np.maximum(ends - k + 1, starts)
    is_word = _WORD[low] if n else np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], is_word[:-1])) if n else is_word
    first = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate((is_word[1:], [False])) if n else is_word
    last = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(wide * up[:n], out=total[1:])
    words = (total[last] - total[first]) * down[first]
    w0, w1 = np.searchsorted(first, starts), np.searchsorted(first, ends)
    yield "word1", _slot(words, 11), w0, w1
    yield "word2", _slot(words[1:] - words[:-1], 12), w0, np.maximum(w1 - 1, w0)


def _row_sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    a, b = np.minimum(a, len(values)), np.minimum(b, len(values))
    return total[np.maximum(a, b)] - total[a]


@dataclass
class TextModel:
    """Logistic regression: one weight per family and slot. calibrated: Platt's slope and shift."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    classes: int = 2
    note: dict = field(default_factory=dict)

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Calibrated log-odds of each whole text."""
        data, off = buffers(texts)
        out = np.empty(len(off) - 1)
        for i, j in chunks(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            z = np.full(j - i, self.bias)
            for f, (_, slots, a, b) in enumerate(hashed(part, o)):
                z += SCALE * _row_sums(self.weights[f][slots], a, b) / (np.maximum(b - a, 0) + DAMP)
            out[i:j] = z
        return self.slope * out + self.shift


@dataclass
class Rows:
    """Sparse rows: the slots and values of row i are at start[i]:start[i + 1]."""

    slot: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(self.slot[at], self.value[at], start)

    def blocks(self):
        """Runs of rows (a, b) of at most BLOCK values (a longer row is a run by itself)."""
        a, n = 0, len(self.start) - 1
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.start, self.start[a] + BLOCK, "right")) - 1))
            yield a, b
            a = b

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start) - 1)
        for a, b in self.blocks():
            i, j = self.start[a], self.start[b]
            out[a:b] = _row_sums(w[self.slot[i:j]] * self.value[i:j], self.start[a:b] - i, self.start[a + 1 : b + 1] - i)
        return out

    def weighted(self, g: np.ndarray, dim: int) -> np.ndarray:
        """The sum of all rows, each times its g."""
        out = np.zeros(dim)
        for a, b in self.blocks():
            i, j = self.start[a], self.start[b]
            out += np.bincount(self.slot[i:j], weights=np.repeat(g[a:b], np.diff(self.start[a : b + 1])) * self.value[i:j], minlength=dim)
        return out


def features(texts: pa.Array) -> Rows:
    data, off = buffers(texts)
    slots, values, sizes = [], [], []
    for i, j in chunks(off, 2 * CHUNK):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        keys, vals, rows = [], [], []
        for f, (_, s, a, b) in enumerate(hashed(part, o)):
            size = np.maximum(b - a, 0)
            row = np.repeat(np.arange(j - i), size)
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            key, count = np.unique(row * (1 << BITS) + s[at], return_counts=True)
            r = key >> BITS
            keys.append((key & ((1 << BITS) - 1)) + (f << BITS))
            vals.append(SCALE * count / (size[r] + DAMP))
            rows.append(r)
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        slots.append(np.concatenate(keys)[order].astype(np.int32))
        values.append(np.concatenate(vals)[order].astype(np.float32))
        sizes.append(np.bincount(row, minlength=j - i))
    if not slots:
        return Rows(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64))
    # one after the other, so that only one of them is there twice
    slot = np.concatenate(slots)
    slots.clear()
    return Rows(slot, np.concatenate(values), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Rows, y: np.ndarray, dim: int, steps: int = 60, rate: float = 0.08, l2: float = 1e-5, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Full-batch Adam, from start if given; both classes weigh the same."""
    w, bias = (np.zeros(dim), 0.0) if start is None else (start[0].copy(), start[1])
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for t in range(1, steps + 1):
        g = (sigmoid(x.dot(w) + bias) - y) * weight
        gw = x.weighted(g, dim) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, bias


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y to z, with Platt's smoothed targets (Newton's method)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
        if np.abs(d).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def prior_shift(y: np.ndarray, share: float | None) -> float:
    """What log-odds calibrated on y gain when the positive share is not that of y."""
    own = (y.sum() + 1) / (len(y) + 2)
    share = own if share is None else min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)) - np.log(own / (1 - own)))


def fit_text_model(texts: pa.Array, y: np.ndarray, share: float | None = None, seed: int = 7, held: float = 0.25) -> TextModel:
    """Fits on 1 - held of the rows and calibrates on the rest. Too few rows of a class give the rate for any text.

    share: the positive share among all labelled rows, where the sample's own differs; the calibration is moved to it.
    """
    y = np.asarray(y, float)
    dim = len(FAMILIES) << BITS
    if len(y) < 8 or min((y > 0).sum(), (y <= 0).sum()) < 4:
        rate = (y.sum() + 1) / (len(y) + 2)
        return TextModel(np.zeros((len(FAMILIES), 1 << BITS), np.float32), float(np.log(rate / (1 - rate))), classes=1)
    x = features(texts)
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(np.flatnonzero(y > 0)), rng.permutation(np.flatnonzero(y <= 0))])
    fold = np.zeros(len(y), bool)
    fold[order[:: max(2, round(1 / held))]] = True
    train, test = np.flatnonzero(~fold), np.flatnonzero(fold)
    w, bias = fit_logistic(x.take(train), y[train], dim)
    z = x.take(test).dot(w) + bias
    slope, shift = platt(z, y[test])
    shift += prior_shift(y[test], share)
    right = float((((slope * z + shift) > 0) == (y[test] > 0)).mean())
    return TextModel(w.astype(np.float32).reshape(len(FAMILIES), -1), bias, slope, shift, note={"held_out": len(test), "accuracy": right})
