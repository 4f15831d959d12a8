import gzip
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import warc


def pages(spark):
    rnd = random.Random(3)
    rows = [(i, f"https://h{i % 3}.example/{i}", "<p>" + "word " * rnd.randint(0, 300) + f"{i}</p>") for i in range(60)]
    rows += [(60, "https://x.example/a b\n", "same"), (61, None, "same"), (61, None, "same"), (None, "https://no.id/", "own"), (63, "", ""), (64, "https://n.example/", None), (65, "https://l.example/", "long " * 200_000), (66, "https://u.example/é文", "ünï\r\n\r\nWARC/1.0\r\n")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("x"), "offset": F.lit(1), "digest": F.lit(2)})


@pytest.mark.parametrize("archive", [warc.ARCHIVE, 4000])
def test_round_trip(spark, folder, archive):
    rows, df = pages(spark)
    files = warc.write(df.repartition(3), folder, "page_id", "url", "html", archive)
    index = warc.index(files)
    assert index.columns == ["file", "offset", "length", "record_id", "url", "digest"]
    assert index.count() == len(rows) == files.agg(F.sum("records")).first()[0]
    got = warc.read(index)
    want = sorted((f"urn:page:{'' if i is None else i}", None if u is None else warc._UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u), (h or "").encode()) for i, u, h in rows)
    same = lambda rs: sorted(((r.record_id, r.url, bytes(r.payload)) for r in rs), key=repr)
    assert same(got.collect()) == sorted([(a, b or None if b is not None and b else b, c) for a, b, c in want], key=repr)
    assert all(warc.digest_of(bytes(r.payload)) == r.digest for r in got.collect())
    few = index.where("url like '%h1.example%'")
    assert {r.record_id for r in warc.read(few, gap=0).collect()} == {f"urn:page:{i}" for i in range(1, 60, 3)}
    assert warc.read(few.unionByName(few)).count() == 2 * few.count()
    assert warc.read(index.limit(0)).count() == 0
    best = warc.first_of_each_digest(index)
    assert best.count() == len({(h or "") for _, _, h in rows})
    assert {r.record_id for r in best.where(F.col("digest") == warc.digest_of(b"same")).collect()} == {"urn:page:60"}


def test_each_record_is_where_the_index_says(spark, folder, tmp_path):
    rows, df = pages(spark)
    for r in warc.index(warc.write(df, folder, "page_id", "url", "html")).collect():
        raw = open(r.file.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        headers, payload = warc.parse(gzip.decompress(raw))
        assert headers["warc-record-id"] == f"<{r.record_id}>" and warc.digest_of(payload) == r.digest


def test_plain_archives_and_missing_headers(spark, tmp_path):
    a = warc.record("urn:page:1", "https://a/", b"one")
    b = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\ntwo\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(a + b)
    (tmp_path / "none.warc").write_bytes(b"")
    names = spark.createDataFrame([(f"file://{tmp_path}/plain.warc",), (f"file://{tmp_path}/plain.warc",), (f"file://{tmp_path}/none.warc",), (None,)], "file string")
    index = warc.index(names)
    assert [(r.offset, r.length, r.record_id, r.url, r.digest) for r in index.orderBy("offset").collect()] == [(0, len(a), "urn:page:1", "https://a/", warc.digest_of(b"one")), (len(a), len(b), "", None, warc.digest_of(b"two"))]
    assert sorted(bytes(r.payload) for r in warc.read(index).collect()) == [b"one", b"two"]


@pytest.mark.parametrize("hurt", [lambda d: d[:-9], lambda d: d[:40], lambda d: b"\x1f\x8b" + d[12:], lambda d: b"not a WARC record\r\n\r\n"])
def test_damaged_archives_are_named(spark, tmp_path, hurt):
    (tmp_path / "bad.warc.gz").write_bytes(hurt(gzip.compress(warc.record("urn:page:1", "u", b"x" * 500))))
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.index(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "file string"))


def test_wrong_payloads_are_found(spark, tmp_path):
    raw = warc.record("urn:page:1", "u", b"payload")
    (tmp_path / "a.warc").write_bytes(raw)
    index = warc.index(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "file string"))
    (tmp_path / "a.warc").write_bytes(raw.replace(b"payload", b"pAyload"))
    with pytest.raises(Exception, match="digest"):
        warc.read(index).collect()


def test_ranges():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (200, 10)], gap=10, span=100) == [(0, 3, 0, 25), (3, 4, 200, 10)]
    assert warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=0, span=20) == [(0, 2, 0, 20), (2, 3, 20, 10)]
    assert warc.coalesced([]) == [] and warc.coalesced([(5, 1000)], 0, 10) == [(0, 1, 5, 1000)]
    rnd = random.Random(1)
    spans, at = [], 0
    for _ in range(200):
        at += rnd.randint(0, 50)
        spans.append((at, rnd.randint(1, 30)))
        at += spans[-1][1]
    out = warc.coalesced(spans, 20, 200)
    assert [i for a, b, _, _ in out for i in range(a, b)] == list(range(200))
    assert all(o <= spans[i][0] and spans[i][0] + spans[i][1] <= o + n for a, b, o, n in out for i in range(a, b))


def test_no_pages(spark, folder):
    df = pages(spark)[1].limit(0)
    files = warc.write(df, folder, "page_id", "url", "html")
    assert files.count() == 0 and warc.index(files).count() == 0
