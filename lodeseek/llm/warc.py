"""WARC archives: index first, then coalesced byte-range reads of the selected records.

index() walks each archive once, in parallel by file, and gives offset, length, URL and digest of each record.
Any selection of index rows is then read: sorted by file and offset, neighbours are joined to one range as
long as the gap and the range stay small, and each range is one read. Paths are read and written through
pyarrow.fs, so a folder may be of any file system that pyarrow knows by its URI.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import shared_dir, table, written

#: Ranges are joined over gaps up to GAP bytes as long as they span at most SPAN bytes.
GAP, SPAN = 64 << 10, 4 << 20
#: An archive is closed and another one begun at this size.
ARCHIVE = 64 << 20
#: Reads of one archive are spread over tasks by stretches of so many bytes.
STRETCH = 16 << 20
_BLOCK = 1 << 20
_INDEX = "file string, offset long, length long, record_id string, url string, digest string"
_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("digest", pa.string())])
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def record(record_id: str, url: str | None, payload: bytes) -> bytes:
    """A resource record. Blanks and control characters of a URL are percent-encoded; a null URL has no header."""
    head = [b"WARC/1.0", b"WARC-Type: resource", f"WARC-Record-ID: <{record_id}>".encode()]
    if url is not None:
        head.append(f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}".encode())
    head += [f"WARC-Payload-Digest: {digest_of(payload)}".encode(), b"Content-Type: text/html", f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lowered) and payload of an unpacked record. Raises ValueError if it isn't one."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers.get("content-length", 0))]


def _index_row(file: str, offset: int, length: int, raw: bytes) -> tuple:
    headers, payload = parse(raw)
    return file, offset, length, headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), headers.get("warc-payload-digest") or digest_of(payload)


def write(rows: DataFrame, folder: str, id_col: str, url_col: str, body_col: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row to gzipped archives in folder (a member each); (file, records) of each archive.

    Each attempt of a task names its archives anew, and only those that the returned table lists are whole.
    """

    def emit(batches):
        there, base = fs.FileSystem.from_uri(folder)
        there.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = there.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = pack.compress(record(f"urn:page:{'' if i is None else i}", u, (h or "").encode())) + pack.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= archive:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [count]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [count]})

    return written(rows.select(id_col, url_col, body_col).mapInArrow(emit, "file string, records long"))


def _members(stream):
    """(offset, length, unpacked bytes) of each gzip member, or of each record of an archive that isn't packed."""
    have, at = b"", 0
    have = stream.read(_BLOCK)
    if have[:2] == b"\x1f\x8b":
        while have:
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not have:
                    have = stream.read(_BLOCK)
                    if not have:
                        raise ValueError(f"the archive ends inside the member at {at}")
                parts.append(unpack.decompress(have))
                used += len(have) - len(unpack.unused_data)
                have = unpack.unused_data
            yield at, used, b"".join(parts)
            at += used
            have = have or stream.read(_BLOCK)
        return
    while have:
        while b"\r\n\r\n" not in have:
            more = stream.read(_BLOCK)
            if not more:
                raise ValueError(f"the archive ends inside the record at {at}")
            have += more
        headers, _ = parse(have)
        size = have.index(b"\r\n\r\n") + 4 + int(headers.get("content-length", 0)) + 4
        parts, length = [have], len(have)
        while length < size:
            more = stream.read(max(_BLOCK, size - length))
            if not more:
                raise ValueError(f"the archive ends inside the record at {at}")
            parts.append(more)
            length += len(more)
        have = b"".join(parts)
        yield at, size, have[:size]
        at, have = at + size, have[size:] or stream.read(_BLOCK)


def index(files: DataFrame, per_task: int = 1) -> DataFrame:
    """(file, offset, length, record_id, url, digest) of every record of the archives in column file.

    length is that of the packed member. Records without a digest get that of their payload; a record
    without a URL has a null one. Null names are dropped, repeated names read once. A damaged archive is an
    error that names its file.
    """

    def walk(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                there, path = fs.FileSystem.from_uri(file)
                rows = []
                try:
                    with there.open_input_stream(path, compression=None) as stream:
                        for at, length, raw in _members(stream):
                            rows.append(_index_row(file, at, length, raw))
                            if len(rows) == 5000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_ARROW)], schema=_INDEX_ARROW)
                                rows = []
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_ARROW)], schema=_INDEX_ARROW)

    names = files.select("file").where("file is not null").distinct()
    spread = max(1, -(-names.count() // per_task))
    return written(names.repartition(spread, "file").mapInArrow(walk, _INDEX))


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """Joins sorted (offset, length): (first row, end row, offset, length) of each read."""
    out: list[list[int]] = []
    for i, (at, n) in enumerate(spans):
        if out and at - (out[-1][2] + out[-1][3]) <= gap and at + n - out[-1][2] <= span:
            out[-1][1], out[-1][3] = i + 1, max(out[-1][3], at + n - out[-1][2])
        else:
            out.append([i, i + 1, at, n])
    return [tuple(x) for x in out]


def read(selected: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """selected (rows of an index) with the column payload, the bytes of each record. Checks each digest.

    Repeated rows are read once and given as often as they are there.
    """
    names = ["file", "offset", "length", "record_id", "url", "digest"]
    schema = pa.schema([*_INDEX_ARROW, ("payload", pa.binary())])

    def fetch(batches):
        def flush(rows):
            there, path = fs.FileSystem.from_uri(rows[0][0])
            with there.open_input_file(path) as f:
                for i, j, at, n in coalesced([(r[1], r[2]) for r in rows], gap, span):
                    block = f.read_at(n, at)
                    out = []
                    for r in rows[i:j]:
                        raw = block[r[1] - at : r[1] - at + r[2]]
                        _, payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                        if r[5].startswith("sha256:") and digest_of(payload) != r[5]:
                            raise ValueError(f"{r[0]} at {r[1]}: the payload isn't that of its digest")
                        out.append((*r, payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                # a read never goes over a file's end, nor further than span
                if held and (row[0] != held[0][0] or row[1] + row[2] - held[0][1] > span):
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    rows = selected.select(*names).repartition("file", F.expr(f"offset div {STRETCH}")).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(fetch, f"{_INDEX}, payload binary")


def first_of_each_digest(rows: DataFrame) -> DataFrame:
    """The index rows without repeated payloads: of those of one digest the least page number stays (a missing one is the largest)."""
    number = F.coalesce(F.expr("try_cast(substring(record_id, 10) as bigint)"), F.lit(2**63 - 1))
    best = rows.groupBy("digest").agg(F.min(F.struct(number.alias("n"), "file", "offset")).alias("best"))
    return rows.join(best.select("best.file", "best.offset"), ["file", "offset"], "left_semi")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, digest): pages archived, indexed, and one record of each digest read back.

    A null html is archived as an empty payload.
    """
    pages = table(spark, sf_dir, "pages")
    archives = write(pages, shared_dir(spark), "page_id", "url", "html")
    records = read(first_of_each_digest(index(archives)))
    return records.select(F.expr("try_cast(substring(record_id, 10) as bigint)").alias("page_id"), "url", F.decode("payload", "UTF-8").alias("html"), "digest")


SQL = """
select arg_min(page_id, coalesce(page_id, 9223372036854775807)) as page_id, arg_min(url, coalesce(page_id, 9223372036854775807)) as url, coalesce(html, '') as html, 'sha256:' || sha256(coalesce(html, '')) as digest
from pages group by coalesce(html, '')
"""
