"""TIFF media columns: one row per page of each image.

decode() walks the chain of image directories of classic and big files in either byte order, gathers strips or
tiles in chunky or planar order, unpacks them (none, PackBits, LZW, deflate), undoes the predictor (none,
horizontal differences, floating point) and gives the pixels as little-endian rows. encode() writes such files.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Most bytes that one page's pixels may take (a parameter of decode() and pages()): an Arrow value holds no more than 2 GiB. A page
#: that claims more is an error row, not a lost executor.
MOST_PIXELS = 1 << 30
#: What a damaged file can raise while it is read.
_DAMAGE = (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error, zlib.error)
#: Bytes with their bits the other way round.
_TURNED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).tobytes()


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    kind: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray
    tags: dict = field(default_factory=dict)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += c + 2
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes are packed, the rest is copied."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(a)))
    out, at = bytearray(), 0

    def copy(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes > 2):
        s, n = int(starts[k]), int(sizes[k])
        copy(s)
        while n > 1:
            m = min(n, 128)
            out.append(257 - m)
            out.append(data[s])
            s, n = s + m, n - m
        at = s
    copy(len(data))
    return bytes(out)


#: After a clear code, the widths of the codes up to the next one, and the bits before each.
_WIDTHS = np.array([9] * 254 + [10] * 512 + [11] * 1024 + [12] * 2048, np.int64)
_BEFORE = np.concatenate(([0], np.cumsum(_WIDTHS)))


def _codes(data: np.ndarray, bit: int) -> np.ndarray:
    """The codes from bit on, as far as data goes, one table's length at most. data ends with four bytes more."""
    n = min(len(_WIDTHS), int(np.searchsorted(_BEFORE, (len(data) - 4) * 8 - bit, "right")) - 1)
    at = bit + _BEFORE[:n]
    i = at >> 3
    word = (data[i].astype(np.int64) << 16) | (data[i + 1].astype(np.int64) << 8) | data[i + 2]
    return (word >> (24 - (at & 7) - _WIDTHS[:n])) & ((1 << _WIDTHS[:n]) - 1)


def unlzw(data: bytes) -> bytes:
    """Code widths depend only on the number of codes since the last clear code, so all codes up to the next are read at once."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out, bit, first = [], 0, True
    while True:
        codes = _codes(raw, bit)
        if first and (not len(codes) or codes[0] != 256):
            if not len(data):
                return b""
            raise TiffError("LZW data that doesn't begin with a clear code")
        skip = 1 if first else 0
        ends = np.flatnonzero((codes[skip:] == 256) | (codes[skip:] == 257))
        stop = int(ends[0]) + skip if len(ends) else len(codes)
        if first:
            # the clear code itself is of 9 bits and comes before the table's first code
            bit, first = bit + 9, False
            continue
        own = codes[:stop].tolist()
        words, last = base.copy(), None
        grow = words.append
        for c in own:
            if last is None:
                word = words[c] if c < 256 else None
                if word is None:
                    raise TiffError("LZW code out of the table")
            else:
                if c < len(words):
                    word = words[c]
                elif c == len(words):
                    word = last + last[:1]
                else:
                    raise TiffError("LZW code out of the table")
                grow(last + word[:1])
            out.append(word)
            last = word
        if stop == len(codes) or codes[stop] == 257:
            return b"".join(out)
        bit += int(_BEFORE[stop + 1])


def _width(size: int) -> int:
    return 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12


def lzw(data: bytes) -> bytes:
    """Packs; entries of the table are found by (code of the word so far, next byte)."""
    codes, bits = [256], [9]
    own: dict[int, int] = {}
    find = own.get
    size, width, last = 258, 9, data[0] if data else -1
    for byte in data[1:]:
        longer = find(last << 8 | byte)
        if longer is not None:
            last = longer
            continue
        codes.append(last)
        bits.append(width)
        own[last << 8 | byte] = size
        last = byte
        size += 1
        if size == 4094:
            codes.append(256)
            bits.append(12)
            own.clear()
            size, width = 258, 9
        elif size in (512, 1024, 2048):
            width += 1
    if data:
        codes.append(last)
        bits.append(width)
        width = _width(size + 1)
    codes.append(257)
    bits.append(width)
    c, b = np.asarray(codes, np.int64), np.asarray(bits, np.int64)
    # as bits, the highest first
    wide = ((c[:, None] << (12 - b)[:, None]) >> np.arange(11, -1, -1)) & 1
    return np.packbits(wide[np.arange(12) < b[:, None]].astype(np.uint8)).tobytes()


def unpack(data: bytes, compression: int, need: int) -> bytes:
    """The need bytes of a strip or tile; there may be more."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpackbits(data)
    if compression == LZW:
        return unlzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, max(1, need))
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {compression} isn't supported")


def _dtype(bits: int, kind: int) -> np.dtype:
    if bits not in (8, 16, 32, 64) or kind == 3 and bits == 8:
        raise TiffError(f"{bits} bits of format {kind} aren't supported")
    return np.dtype({1: "u", 2: "i", 3: "f"}.get(kind, "u") + str(bits // 8))


def unpredict(raw: np.ndarray, predictor: int, width: int, samples: int, dtype: np.dtype, order: str) -> np.ndarray:
    """Rows of width pixels of samples each, from the bytes of a strip or tile (whole rows)."""
    if predictor == 3:
        n = dtype.itemsize
        flat = np.frombuffer(raw, np.uint8).reshape(-1, width * samples * n)
        # differences of bytes, over the pixel's samples
        total = np.cumsum(flat.reshape(len(flat), -1, samples), axis=1, dtype=np.uint8).reshape(len(flat), n, width * samples)
        return np.ascontiguousarray(total.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(-1, width, samples).astype(dtype)
    rows = np.frombuffer(raw, dtype.newbyteorder(order)).reshape(-1, width, samples)
    if predictor == 2:
        u = np.dtype(f"u{dtype.itemsize}")
        return np.cumsum(rows.astype(dtype).view(u), axis=1, dtype=u).view(dtype)
    if predictor != 1:
        raise TiffError(f"predictor {predictor} isn't supported")
    return rows.astype(dtype)


def predict(rows: np.ndarray, predictor: int, order: str) -> bytes:
    h, width, samples = rows.shape
    dtype = rows.dtype
    if predictor == 3:
        n = dtype.itemsize
        planes = np.ascontiguousarray(rows.astype(dtype.newbyteorder(">"))).view(np.uint8).reshape(h, width * samples, n).transpose(0, 2, 1).reshape(h, -1, samples)
        return np.diff(planes, axis=1, prepend=np.zeros((h, 1, samples), np.uint8)).astype(np.uint8).tobytes()
    if predictor == 2:
        u = rows.view(np.dtype(f"u{dtype.itemsize}"))
        rows = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], axis=1).view(dtype)
    return rows.astype(dtype.newbyteorder(order)).tobytes()


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        mark = data[:2]
        if mark not in (b"II", b"MM") or len(data) < 8:
            raise TiffError("not a TIFF file")
        self.order = "<" if mark == b"II" else ">"
        version = self.get("H", 2)
        if version == 43:
            if self.get("H", 4) != 8:
                raise TiffError("offsets of a big file must have 8 bytes")
            self.big, self.first = True, self.get("Q", 8)
        elif version == 42:
            self.big, self.first = False, self.get("I", 4)
        else:
            raise TiffError(f"version {version}")

    def get(self, code: str, at: int) -> int:
        return self.many(code, at, 1)[0]

    def many(self, code: str, at: int, n: int) -> tuple:
        size = struct.calcsize(code) * n
        if at < 0 or at + size > len(self.data):
            raise TiffError(f"{size} bytes at {at} lie outside the file")
        return struct.unpack_from(f"{self.order}{n}{code}", self.data, at)

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        n, entry, head, code = (self.get("Q", at), 20, 8, "Q") if self.big else (self.get("H", at), 12, 2, "I")
        if at + head + n * entry > len(self.data):
            raise TiffError(f"the directory at {at} lies outside the file")
        tags = {}
        for i in range(n):
            e = at + head + i * entry
            tag, kind = self.many("H", e, 2)
            count = self.get(code, e + 4)
            size = _SIZES.get(kind, 0) * count
            where = e + (12 if self.big else 8)
            if size > (8 if self.big else 4):
                where = self.get(code, where)
            if kind in (2, 7):
                tags[tag] = (self.data[where : where + count],)
            elif kind in (5, 10):
                tags[tag] = self.many("I" if kind == 5 else "i", where, 2 * count)
            elif kind in _CODES:
                tags[tag] = self.many(_CODES[kind], where, count)
        return tags, self.get(code, at + head + n * entry)

    def directories(self):
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            tags, at = self.directory(at)
            yield tags


def _page(data: bytes, order: str, tags: dict[int, tuple], most: int = MOST_PIXELS) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags:
            if len(tags[tag]) < 1 or not isinstance(tags[tag][0], int):
                raise TiffError(f"tag {tag} has no whole number")
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples = one(256), one(257), one(277, 1)
    bits, kind, compression, predictor, planar = one(258, 1), one(339, 1), one(259, 1), one(317, 1), one(284, 1)
    if min(width, height, samples) < 1 or len(set(tags.get(258, (bits,)))) > 1:
        raise TiffError("no pixels, or samples of different sizes")
    small = bits in (1, 2, 4)
    dtype = np.dtype("u1") if small else _dtype(bits, kind)
    if width * height * samples * dtype.itemsize > most:
        raise TiffError("the page is too large")
    turned = one(266, 1)
    if turned not in (1, 2):
        raise TiffError(f"fill order {turned}")
    if small and predictor != 1:
        raise TiffError(f"predictor {predictor} with {bits} bits isn't supported")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if min(tw, th) < 1:
        raise TiffError("tiles or strips without size")
    across, down = -(-width // tw), -(-height // th)
    offsets, counts = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
    planes = samples if planar == 2 else 1
    depth = 1 if planar == 2 else samples
    if len(offsets) < across * down * planes or len(counts) < len(offsets) and compression != NONE:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), dtype)
    row_bytes = -(-tw * depth * bits // 8) if small else tw * depth * dtype.itemsize
    if min(offsets, default=0) < 0 or min(counts, default=0) < 0 or tw * th * depth * dtype.itemsize > 2 * most:
        raise TiffError("strips or tiles that can't be")
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        rows = th if tiled else min(th, height - y * th)
        need = rows * row_bytes
        count = counts[k] if k < len(counts) else need
        if offsets[k] + count > len(data):
            raise TiffError(f"strip or tile {k} lies outside the file")
        raw = data[offsets[k] : offsets[k] + count]
        raw = unpack(raw.translate(_TURNED) if turned == 2 else raw, compression, need)
        if len(raw) < need:
            raise TiffError(f"strip or tile {k} is too short")
        if small:
            single = np.unpackbits(np.frombuffer(raw[:need], np.uint8).reshape(rows, row_bytes), axis=1)[:, : tw * depth * bits]
            part = single.reshape(rows, tw, depth, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
        else:
            part = unpredict(raw[:need], predictor, tw, depth, dtype, order)
        h, w = min(rows, height - y * th), min(tw, width - x * tw)
        to = slice(plane, plane + 1) if planar == 2 else slice(None)
        out[y * th : y * th + h, x * tw : x * tw + w, to] = part[:h, :w]
    return Page(width, height, samples, bits, kind, compression, predictor, tiled, out, tags)


def decode(data: bytes, most: int = MOST_PIXELS):
    """Yields the Page of each directory, in the order of the chain. Raises TiffError where the file is damaged."""
    try:
        reader = _Reader(data)
        for tags in reader.directories():
            yield _page(data, reader.order, tags, most)
    except TiffError:
        raise
    except _DAMAGE as e:
        raise TiffError(f"{type(e).__name__}: {e}") from e


def encode(pages: list[dict], order: str = "<", big: bool = False) -> bytes:
    """A TIFF file. Each page: pixels (height x width x samples), compression, predictor, and rows (of a strip) or tile (w, h); planar."""
    code, entry_size = ("Q", 20) if big else ("I", 12)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 0) if big else struct.pack(f"{order}HI", 42, 0)))
    link = 8 if big else 4
    for page in pages:
        px = page["pixels"]
        px = px[:, :, None] if px.ndim == 2 else px
        h, w, s = px.shape
        compression, predictor, planar, tile = page.get("compression", NONE), page.get("predictor", 1), page.get("planar", 1), page.get("tile")
        tw, th = tile or (w, page.get("rows", h))
        places, sizes = [], []
        for plane in [px[:, :, i : i + 1] for i in range(s)] if planar == 2 else [px]:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    part = plane[y : y + th, x : x + tw]
                    if tile and part.shape[:2] != (th, tw):
                        part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                    raw = predict(np.ascontiguousarray(part), predictor, order)
                    raw = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 4), OLD_DEFLATE: lambda b: zlib.compress(b, 4)}[compression](raw)
                    places.append(len(out))
                    sizes.append(len(raw))
                    out += raw + b"\0" * (len(raw) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
        own = [(256, 4, [w]), (257, 4, [h]), (258, 3, [px.dtype.itemsize * 8] * s), (259, 3, [compression]), (262, 3, [1]), (277, 3, [s]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * s)]
        own += [(322, 4, [tw]), (323, 4, [th]), (324, 16 if big else 4, places), (325, 4, sizes)] if tile else [(273, 16 if big else 4, places), (278, 4, [th]), (279, 4, sizes)]
        entries = b""
        for tag, typ, values in sorted(own):
            value = struct.pack(f"{order}{len(values)}{_CODES[typ]}", *values)
            if len(value) > (8 if big else 4):
                where = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack(f"{order}{code}", where)
            entries += struct.pack(f"{order}HH{code}", tag, typ, len(values)) + value.ljust(8 if big else 4, b"\0")
        struct.pack_into(f"{order}{code}", out, link, len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(entries) // entry_size) + entries
        link = len(out)
        out += struct.pack(f"{order}{code}", 0)
    return bytes(out)


_PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def pages(images: DataFrame, id_col: str, image_col: str, most: int = MOST_PIXELS) -> DataFrame:
    """(id, page, width, height, samples, bits, compression, predictor, pixels, error): a row per page of each image.

    Pages are numbered from 0. pixels: rows from the top, samples of a pixel together, little endian; of
    1, 2 or 4 bits a byte per sample. Either order of bits in bytes is read. A page of more than most bytes is an error
    row, as it can't be one value; the page after it is not read. Where a file is damaged, pages before that are given, then a row with the
    number of the failed page, null in the other columns, and the reason in error. A null image gives no row,
    an empty one an error row for page 0. Repeated rows give repeated pages; other columns are not read.
    """
    id_type = images.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]

    def read(batches):
        for b in batches:
            ids = b.column(0)
            rows: list[tuple] = []
            held = 0

            def flush():
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int32()) for c in cols[1:8]), pa.array(cols[8], pa.binary()), pa.array(cols[9], pa.string())], names)

            for i, image in enumerate(b.column(1)):
                data = image.as_py()
                if data is None:
                    continue
                n, found = 0, decode(data, most)
                while True:
                    try:
                        p = next(found, None)
                    except TiffError as e:
                        rows.append((i, n, *[None] * 7, str(e)))
                        break
                    if p is None:
                        break
                    raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                    rows.append((i, n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, raw, None))
                    n, held = n + 1, held + len(raw)
                    if held > 16 << 20:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

    return images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image")).mapInArrow(read, f"id {id_type}, {_PAGE}").withColumnRenamed("id", id_col)


#: A raster of text: this many bytes in a row, rows in a page.
WIDTH, HEIGHT = 256, 64
#: (compression, predictor, tiles) of a raster, by its id.
KINDS = [(PACKBITS, 1, False), (LZW, 2, True), (DEFLATE, 2, False), (LZW, 1, False), (NONE, 1, False), (DEFLATE, 1, True)]


def rasters(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, image): each text's UTF-8 bytes as grey pixels of a TIFF file, filled up with 0. Null texts have a null image, empty ones one row of 0."""

    def draw(batches):
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                raw = text.encode()
                raw = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")
                whole = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
                compression, predictor, tiled = KINDS[(k or 0) % len(KINDS)]
                how = {"tile": (64, 32)} if tiled else {"rows": 16}
                out.append(encode([{"pixels": whole[y : y + HEIGHT], "compression": compression, "predictor": predictor, **how} for y in range(0, len(whole), HEIGHT)], "<" if (k or 0) % 2 else ">", (k or 0) % 5 == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "image"])

    id_type = texts.select(id_col).schema[0].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(draw, f"id {id_type}, image binary").withColumnRenamed("id", id_col)


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page, width, height, bits, compression, predictor, digest): pages of the TIFF rasters of the table pages.

    The tables have no images, so each page's whole html is drawn as one first; digest is the MD5 of the
    decoded pixels in upper-case hex digits.
    """
    images = rasters(table(spark, sf_dir, "pages"), "page_id", "html")
    found = pages(images, "page_id", "image")
    return found.select("page_id", "page", "width", "height", "bits", "compression", "predictor", F.md5(F.hex("pixels")).alias("digest"))


SQL = f"""
with raw as (
  select page_id, hex(encode(html)) as h, greatest(1, ceil(octet_length(encode(html)) / {WIDTH}.0))::int as lines from pages where html is not null
), cut as (
  select page_id, h, lines, unnest(generate_series(0, (lines - 1) // {HEIGHT})) as page from raw
), sized as (
  select page_id, page, least({HEIGHT}, lines - page * {HEIGHT})::int as height, substr(h, 1 + page * {2 * WIDTH * HEIGHT}, {2 * WIDTH * HEIGHT}) as part, coalesce(page_id, 0) % {len(KINDS)} as k from cut
)
select page_id, page::int as page, {WIDTH} as width, height, 8 as bits, {[k[0] for k in KINDS]}[k + 1] as compression, {[k[1] for k in KINDS]}[k + 1] as predictor,
  md5(rpad(part, height * {2 * WIDTH}, '0')) as digest from sized
"""
