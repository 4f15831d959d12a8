"""Best-two-fit packing of documents into sequences of CAPACITY tokens.

Documents fall into groups by a hash, of about GROUP documents whatever the table's size; groups are packed
side by side. In a group one bin after another is filled greedily, always with the largest document that
fits. When none does and there is a gap, the bin's smallest document is weighed against the two unpacked
documents that fit into the gap and its own place most tightly; if they take more, they replace it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import n_tokens, table, written

CAPACITY = 2048
#: Documents of a group, about.
GROUP = 20_000


def best_two(count: np.ndarray, least: int, gap: int) -> tuple[int, int]:
    """The two lengths a >= b of the largest sum up to gap, (0, 0) if none; count has the unpacked items by length.

    Of pairs of one sum the one with the larger a counts.
    """
    have = np.flatnonzero(count[: gap - least + 1])
    if not len(have):
        return 0, 0
    at = np.searchsorted(have, np.minimum(have, gap - have), "right") - 1
    twin = (at >= 0) & (have[np.maximum(at, 0)] == have) & (count[have] < 2)
    at = at - twin
    sums = np.where(at >= 0, have + have[np.maximum(at, 0)], 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(have[best]), int(have[at[best]])) if sums[best] else (0, 0)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The bins, as lists of positions in lengths (each 1 to capacity). Equal lengths are taken in their order."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[i], []).append(i)
    count = np.zeros(capacity + 1, np.int64)
    mask = 0
    for n, own in stacks.items():
        count[n], mask = len(own), mask | 1 << n

    def pop(n: int) -> int:
        nonlocal mask
        count[n] -= 1
        if not count[n]:
            mask &= ~(1 << n)
        return stacks[n].pop()

    bins = []
    while mask:
        own, gap, smallest = [], capacity, 0
        while fits := mask & ((1 << (gap + 1)) - 1):
            smallest = fits.bit_length() - 1
            own.append(pop(smallest))
            gap -= smallest
        if gap and mask:
            least = (mask & -mask).bit_length() - 1
            if 2 * least <= gap + smallest:
                a, b = best_two(count, least, gap + smallest)
                if a + b > smallest:
                    back = own.pop()
                    own += [pop(a), pop(b)]
                    stacks[smallest].append(back)
                    count[smallest] += 1
                    mask |= 1 << smallest
        bins.append(own)
    return bins


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, tokens=None) -> DataFrame:
    """(doc_id, bin, slot, start, n_tokens): the piece of n_tokens tokens from start of the document is the slot-th of its bin.

    A document of more than capacity tokens fills bins of its own as often as it can, and its rest is packed
    like a document. tokens: the column expression of a document's tokens (by default those of common.n_tokens).
    Texts without a token (null, empty) are in no bin. Rows with a null doc_id are packed, and doc_id may be of any type that
    can be ordered; repeated rows are counted first, and packed as often as they are there, in several groups. The order of the rows makes no
    difference. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = n_tokens(F.col("text")) if tokens is None else tokens
    rows = docs.select("doc_id", t.alias("t"), F.xxhash64("doc_id", "text").alias("h")).where("t > 0")
    items = written(rows.groupBy("doc_id", "t", "h").agg(F.count("*").alias("copies")))
    groups = max(1, -(-(items.agg(F.sum("copies")).first()[0] or 0) // group))
    each = items.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rest = F.col("t") % capacity
    alone = each.where(f"t >= {capacity}").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"t div {capacity} - 1"))))
    place = F.when(F.col("copy") == 1, F.col("h")).otherwise(F.xxhash64("h", "copy"))
    small = each.where(rest > 0).select(F.pmod(place, F.lit(groups)).alias("g"), "doc_id", "h", "copy", (F.col("t") - rest).alias("start"), rest.cast("int").alias("n"))

    def one(key: tuple, own: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by([(c, "ascending") for c in ("n", "doc_id", "h", "copy")])
        found = pack(own["n"].to_pylist(), capacity)
        sizes = np.fromiter((len(b) for b in found), np.int64, len(found))
        out = own.take(pa.array([i for b in found for i in b], pa.int64()))
        ends = np.cumsum(sizes)
        bins = [f"{key[0].as_py()}-{i}" for i in np.repeat(np.arange(len(found)), sizes)]
        slot = (np.arange(len(out)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        return pa.table({"doc_id": out["doc_id"], "bin": pa.array(bins, pa.string()), "slot": pa.array(slot), "start": out["start"], "n_tokens": out["n"]})

    shared = small.groupBy("g").applyInArrow(one, f"doc_id {kind}, bin string, slot int, start long, n_tokens int")
    whole = alone.select("doc_id", F.concat_ws("-", F.lit("whole"), F.hex("h"), F.col("copy").cast("string"), F.col("i").cast("string")).alias("bin"), F.lit(0).alias("slot"), (F.col("i") * capacity).alias("start"), F.lit(capacity).alias("n_tokens"))
    return whole.unionByName(shared)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
