"""Archives: exact round trips, members that can be read apart, and copies."""

import hashlib
import os
import zlib

from ledgerline.llm import warc
from ledgerline.llm.common import BATCH_BYTES

BIG = "<p>" + "x" * 1200


def test_normaliser_keeps_records():
    blobs = [warc.record(i, f"http://a/\n{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate([b"", b"\r\n\r\n" * 3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\n", bytes(range(256)) * 999])]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    stream = b"".join(map(squeeze.compress, blobs)) + squeeze.flush()
    for step in (7, 1 << 18):
        assert list(warc.split_stream(stream, step)) == blobs
    content, index = warc.rewrite(stream)
    assert [zlib.decompress(content[a : a + n], 31) for a, n in index] == blobs
    assert b"".join(blobs[:0]) == b"" and warc.rewrite(zlib.compress(b"", wbits=31)) == (b"", [])


def test_copies(spark):
    rows = [(1, "u", BIG), (5, None, BIG), (3, "v", BIG), (4, "w", "small"), (6, "w", "small"), (7, "n", None), (8, "n", ""), (None, "z", BIG + "é"), (9, "t", "é" * 600), (9, "t", "é" * 600)]
    pages = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, digest int")
    got = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str)
    payload = lambda h: (h or "").encode()
    want = [(i, len(payload(h)), hashlib.sha1(payload(h)).hexdigest(), "revisit" if i in (1, 3) else "response", 5 if i in (1, 3) else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_survive(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = warc.write_archives(warc.with_originals(pages))
    read = warc.read_records(warc.normalise(plain))
    assert {r.page_id: r.url for r in read.collect()} == {r.page_id: r.url for r in pages.select("page_id", "url").collect()}


def test_archives_of_others(spark, tmp_path):
    """Files of one stream and of many members, lower-case headers, and a record larger than a part."""
    blobs = [f"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length:{len(b)}\r\nWARC-Record-ID: <urn:x:{i}>\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate([b"", b"a" * 50, os.urandom(6 << 20), b"\r\n\r\n"])]
    gz = lambda b: zlib.compress(b, wbits=31)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gz(b"".join(blobs)))
    (tmp_path / "in" / "many.warc.gz").write_bytes(b"".join(map(gz, blobs)))
    assert [len(i) for _, i in warc.rewrite_parts(gz(b"".join(blobs)), 1 << 20)] == [2, 1, 1]
    got = warc.normalise(warc.outside(spark, str(tmp_path / "in")))
    rows = warc.records(got).collect()
    assert len(rows) == 8 and {r.headers["WARC-Record-ID"] for r in rows} == {f"<urn:x:{i}>" for i in range(4)}
    assert sorted(len(r.block) for r in rows) == sorted([0, 50, 6 << 20, 4] * 2)
    files = warc.export(got, str(tmp_path / "out")).collect()
    assert [f.members for f in files] == [4, 4] and len(list((tmp_path / "out").iterdir())) == 4
    for f in files:
        data = (tmp_path / "out" / f.file).read_bytes()
        index = [tuple(map(int, x.split())) for x in (tmp_path / "out" / f.file.replace(".warc.gz", ".idx")).read_text().splitlines()]
        assert [zlib.decompress(data[a : a + n], 31) for a, n in index] == blobs


def test_archives_go_in_bounded_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.range(0, 900, 1, 1).selectExpr("id page_id", "'u' url", "repeat(cast(id as string), 4000) html")
    df = warc.with_originals(pages)
    for step in (warc.write_archives, warc.normalise, warc.read_records):
        spark.conf.unset(limit)
        df = step(df)
        assert int(spark.conf.get(limit).removesuffix("b")) == BATCH_BYTES
    assert df.count() == 900
    spark.conf.unset(limit)
