import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import tiff


def image(dtype, h, w, s, seed=0):
    rng = np.random.default_rng(seed)
    base = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[:, :, None] + rng.integers(0, 3, (h, w, s))
    return (base / 7).astype(dtype) if np.dtype(dtype).kind == "f" else base.astype(dtype)


FORMS = list(itertools.product([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS], [("u1", 1), ("u1", 3), ("u2", 1), ("i2", 3), ("u4", 1), ("f4", 1), ("f8", 3)], [1, 2, 3]))


@pytest.mark.parametrize(("compression", "form", "predictor"), [x for x in FORMS if (x[2] == 3) <= (x[1][0][0] == "f") and not (x[2] == 2 and x[1][0][0] == "f")])
def test_round_trip(compression, form, predictor):
    pages = []
    for k, (layout, planar) in enumerate(itertools.product([{}, {"rows": 5}, {"tile": (16, 32)}], [1, 2])):
        pages.append({"pixels": image(form[0], 37, 23, form[1], k), "compression": compression, "predictor": predictor, "planar": planar, **layout})
    for order, big in (("<", False), (">", True)):
        got = list(tiff.decode(tiff.encode(pages, order, big)))
        assert len(got) == len(pages)
        for p, e in zip(got, pages):
            assert np.array_equal(p.pixels, e["pixels"]) and (p.width, p.height, p.samples) == (23, 37, form[1]) and p.tiled == ("tile" in e)


def test_packbits():
    # the example of the format's description
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpackbits(packed) == plain == tiff.unpackbits(tiff.packbits(plain))
    assert tiff.unpackbits(bytes([128, 0, 65])) == b"A" and tiff.packbits(b"") == b""


@pytest.mark.parametrize("seed", range(12))
def test_packers(seed):
    rnd = random.Random(seed)
    n = rnd.choice([0, 1, 2, 127, 128, 129, 500, 5000, 60_000])
    data = bytes(rnd.choices(range(rnd.choice([1, 2, 7, 256])), k=n))
    assert tiff.unpackbits(tiff.packbits(data)) == data and tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_by_hand():
    # clear, 7, 258, 8, 8, 258, 6, 6, end: the example of the format's description
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    with pytest.raises(tiff.TiffError):
        tiff.unlzw(b"\x00\x00\x00")


def bilevel():
    """A page of 10 x 2 single bits, by hand."""
    data = bytearray(struct.pack("<2sHI", b"II", 42, 12) + bytes([0b10101010, 0b11000000, 0b00000001, 0b01000000]))
    tags = [(256, 3, 1, 10), (257, 3, 1, 2), (258, 3, 1, 1), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 2), (279, 4, 1, 4)]
    data += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return bytes(data)


def test_single_bits():
    (page,) = tiff.decode(bilevel())
    assert page.pixels[:, :, 0].tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1, 1], [0, 0, 0, 0, 0, 0, 0, 1, 0, 1]]


def test_damage():
    whole = tiff.encode([{"pixels": image("u1", 20, 20, 1), "compression": tiff.LZW}] * 2)
    loop = bytearray(tiff.encode([{"pixels": image("u1", 4, 4, 1)}]))
    loop[-4:] = loop[4:8]
    for bad in (b"", b"II", b"XX*\0\0\0\0\0", b"II+\0\0\0\0\0", whole[:100], bytes(loop)):
        with pytest.raises(tiff.TiffError):
            list(tiff.decode(bad))
    rnd = random.Random(0)
    for _ in range(300):
        hurt = bytearray(whole)
        for _ in range(rnd.randint(1, 6)):
            hurt[rnd.randrange(len(hurt))] = rnd.randrange(256)
        try:
            list(tiff.decode(bytes(hurt)))
        except tiff.TiffError:
            pass


def by_tags(tags, data=b"\0" * 64):
    """A file of one directory of (tag, type, count, value of 4 bytes)."""
    head = bytearray(struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data)
    return bytes(head + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", *t[:3]) + (t[3] if isinstance(t[3], bytes) else struct.pack("<I", t[3])) for t in tags) + struct.pack("<I", 0))


GREY = [(256, 3, 1, 4), (257, 3, 1, 4), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 4), (279, 4, 1, 16)]
STRANGE = [(3, 0, 0), (2, 4, b"abc\0"), (11, 1, struct.pack("<f", float("nan"))), (11, 1, struct.pack("<f", float("inf"))), (4, 2**31, 8), (12, 1, 2**32 - 9), (99, 1, 0), (9, 1, struct.pack("<i", -4)), (5, 1, 8)]


def test_strange_tags(spark):
    assert next(tiff.decode(by_tags(GREY))).pixels.shape == (4, 4, 1)
    files = [by_tags([(tag, *strange) if tag == hurt else (tag, *rest) for tag, *rest in GREY]) for hurt, *_ in GREY for strange in STRANGE]
    for f in files:
        try:
            list(tiff.decode(f))
        except tiff.TiffError:
            pass
    rows = tiff.pages(spark.createDataFrame(list(enumerate(files)), "id long, image binary"), "id", "image").collect()
    assert {r.id for r in rows} == set(range(len(files))) and sum(r.error is not None for r in rows) > len(files) / 2


def test_order_of_bits():
    plain, turned = bilevel(), bytearray(bilevel())
    turned[8:12] = bytes(int(f"{b:08b}"[::-1], 2) for b in turned[8:12])
    (page,) = tiff.decode(plain)
    tags = [(256, 3, 1, 10), (257, 3, 1, 2), (258, 3, 1, 1), (259, 3, 1, 1), (266, 3, 1, 2), (273, 4, 1, 8), (278, 3, 1, 2), (279, 4, 1, 4)]
    (other,) = tiff.decode(by_tags(tags, bytes(turned[8:12])))
    assert (page.pixels == other.pixels).all()


@pytest.mark.parametrize("bits", [2, 4])
def test_few_bits(bits):
    px = np.random.default_rng(bits).integers(0, 1 << bits, (3, 5))
    lines = [int("".join(f"{v:0{bits}b}" for v in row).ljust(-(-5 * bits // 8) * 8, "0"), 2).to_bytes(-(-5 * bits // 8), "big") for row in px]
    tags = [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 3), (279, 4, 1, len(b"".join(lines)))]
    (page,) = tiff.decode(by_tags(tags, b"".join(lines)))
    assert (page.pixels[:, :, 0] == px).all()


def test_pages_over_the_bound(spark):
    df = spark.createDataFrame([(1, tiff.encode([{"pixels": image("u1", 4, 4, 1)}, {"pixels": image("u1", 40, 40, 1)}]))], "id long, image binary")
    assert [(r.page, r.error) for r in tiff.pages(df, "id", "image", most=100).orderBy("page").collect()] == [(0, None), (1, "the page is too large")]


def test_pages_of_a_table(spark):
    two = tiff.encode([{"pixels": image("u1", 9, 7, 1), "compression": tiff.PACKBITS}, {"pixels": image("u2", 5, 6, 3), "compression": tiff.DEFLATE, "predictor": 2}], ">")
    broken = two[:-30]
    rows = [(1, two), (1, two), (None, two), (2, None), (3, b""), (4, broken), (5, bilevel()), (6, b"not an image")]
    df = spark.createDataFrame(rows, "id long, image binary").withColumns({"page": F.lit(9), "error": F.lit("x"), "pixels": F.lit(1)})
    got = tiff.pages(df, "id", "image").collect()
    assert [(r.id, r.page) for r in got if r.error is None and r.id in (1, None)] == [(1, 0), (1, 1), (1, 0), (1, 1), (None, 0), (None, 1)]
    first = [r for r in got if r.id == 1][:2]
    assert bytes(first[0].pixels) == image("u1", 9, 7, 1).tobytes() and bytes(first[1].pixels) == image("u2", 5, 6, 3).astype("<u2").tobytes()
    assert {(r.id, r.page) for r in got if r.error is not None} >= {(3, 0), (6, 0)} and not [r for r in got if r.id == 2]
    assert all(r.pixels is None and r.width is None for r in got if r.error is not None)
    assert tiff.pages(df.limit(0), "id", "image").count() == 0


def test_rasters(spark):
    rows = [(1, "é" * 40_000), (2, ""), (3, None), (None, "abc"), (5, "x" * 256)]
    made = tiff.rasters(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {}
    for r in tiff.pages(made, "id", "image").orderBy("page").collect():
        assert r.error is None
        got[r.id] = got.get(r.id, b"") + bytes(r.pixels)
    assert got == {i: t.encode().ljust(max(1, -(-len(t.encode()) // 256)) * 256, b"\0") for i, t in rows if t is not None}
