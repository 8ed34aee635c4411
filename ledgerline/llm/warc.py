"""WARC archives of pages, and the normaliser of archives that are one gzip stream.

``write_archives`` packs records into archives that are a single gzip member each, as some crawlers leave them.
``normalise`` inflates such a stream once, rewrites every record as a gzip member of its own and gives a sidecar index of
(offset, length) so that a reader can fetch one record without the rest. ``read_records`` goes through that index.

Archives are rows with a binary column, staged in the shared folder by Spark's writer once they are normalised: tasks that
are lost are run again and leave no half-written archive. ``outside`` takes archives of others from files, ``records`` gives all
headers and blocks of a normalised archive, ``export`` writes archives and their indexes as files.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import in_batches, slices, staged

#: Payloads from this many bytes on are stored once.
LEAST = 1000
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
LEVEL = 1
SALTS = 16
#: Bytes of members after which a normalised archive goes on in another part; a member is never parted.
PART_BYTES = 64 << 20
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _value(x: object) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(x))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and length of the payload and refers to the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + _END + body + _END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(_END)
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip(): value.strip() for name, _, value in lines}
    length = next(int(v) for k, v in fields.items() if k.lower() == "content-length")
    return fields, rest[:length]


def split_stream(archive: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The records of a gzip stream that is inflated once, piece by piece; at most a record and a piece are held.

    A stream may be one member for all records or any number of members, cut anywhere.
    """
    held, start = bytearray(), 0
    for piece in _inflated(archive, step):
        held += piece
        while (end := held.find(_END, start)) >= 0:
            length = int(_LENGTH.search(bytes(held[start:end]))[1])
            stop = end + len(_END) + length + len(_END)
            if stop > len(held):
                break
            yield bytes(held[start:stop])
            start = stop
        del held[:start]
        start = 0
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _inflated(archive: bytes, step: int) -> Iterator[bytes]:
    inflate, view = zlib.decompressobj(31), memoryview(archive)
    for k in range(0, len(view), step):
        data = view[k : k + step]
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def rewrite_parts(archive: bytes, most: int = PART_BYTES) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Parts of the archive with a gzip member for each record, and (offset, length) of each member in its part."""
    out, index, at = [], [], 0
    for data in split_stream(archive):
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = squeeze.compress(data) + squeeze.flush()
        if out and at + len(member) > most:
            yield b"".join(out), index
            out, index, at = [], [], 0
        out.append(member)
        index.append((at, len(member)))
        at += len(member)
    if out:
        yield b"".join(out), index


def rewrite(archive: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The whole archive with a gzip member for each record, and (offset, length) of each member."""
    return next(rewrite_parts(archive, 1 << 62), (b"", []))


def with_originals(pages: DataFrame) -> DataFrame:
    """Pages with payload, its digest and length, and the id of the response that a revisit refers to.

    Copies are counted per digest with map-side sums; the join back deals each digest out over ``SALTS`` keys, so a page
    that a third of all rows repeat does not meet in one task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    copies = rows.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    salted = copies.select("digest", "bytes", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    found = rows.withColumn("salt", salt).join(salted, ["digest", "bytes", "salt"], "left")
    return found.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame) -> DataFrame:
    """(archive string, content binary): records of ``with_originals`` in archives of one gzip stream each."""
    arrow = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, out, size = None, [], 0

        def closed() -> pa.RecordBatch:
            content = b"".join(out) + squeeze.flush()
            return pa.RecordBatch.from_pydict({"archive": [hashlib.sha1(content).hexdigest()], "content": [content]}, schema=arrow)

        for batch in batches:
            for part in slices(batch, "payload"):
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    data = record(*row)
                    squeeze = squeeze or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.append(squeeze.compress(data))
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        squeeze, out, size = None, [], 0
        if squeeze:
            yield closed()

    return in_batches(rows.select("page_id", "url", "payload", "digest", "refers_to"), run, "archive string, content binary")


def outside(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of gzip archives in files, read by Spark from any store; a file is a row and must fit a task."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, part, content, sidecar): every record a gzip member of its own, with the offset index beside the part."""
    entry = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    arrow = pa.schema([("archive", pa.string()), ("part", pa.int32()), ("content", pa.binary()), ("sidecar", entry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                for part, (data, index) in enumerate(rewrite_parts(content.as_buffer())):
                    yield pa.RecordBatch.from_pydict({"archive": [name], "part": [part], "content": [data], "sidecar": [[{"offset": a, "length": n} for a, n in index]]}, schema=arrow)

    return in_batches(archives.select("archive", "content"), run, "archive string, part int, content binary, sidecar array<struct<offset: long, length: long>>")


def records(archives: DataFrame) -> DataFrame:
    """(archive, part, offset, length, headers, block) of every record of normalised archives."""
    arrow = pa.schema([("archive", pa.string()), ("part", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, content, sidecar in zip(*(batch.column(c) for c in ("archive", "part", "content", "sidecar")), strict=True):
                view = memoryview(content.as_buffer())
                for x in sidecar.as_py():
                    fields, block = parse(zlib.decompress(view[x["offset"] : x["offset"] + x["length"]], 31))
                    got = [[name.as_py()], [part.as_py()], [x["offset"]], [x["length"]], [list(fields.items())], [block]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, arrow.types, strict=True)], schema=arrow)

    return in_batches(archives.select("archive", "part", "content", "sidecar"), run, "archive string, part int, offset long, length long, headers map<string, string>, block binary")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """(file, members): normalised archives as ``.warc.gz`` files with an index file of "offset length" lines beside each.

    ``folder`` is a path that tasks can write. A file gets its name when it is whole, so a task that is run again leaves no
    half file and no second one.
    """
    arrow = pa.schema([("file", pa.string()), ("members", pa.int64())])

    def put(name: str, data: bytes) -> None:
        os.makedirs(folder, exist_ok=True)
        attempt = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(attempt, "wb") as f:
            f.write(data)
        os.replace(attempt, os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, content, sidecar in zip(*(batch.column(c) for c in ("archive", "part", "content", "sidecar")), strict=True):
                stem = f"{hashlib.sha1(name.as_py().encode()).hexdigest()}-{part.as_py():05d}"
                put(f"{stem}.warc.gz", content.as_buffer())
                put(f"{stem}.idx", "".join(f"{x['offset']} {x['length']}\n" for x in sidecar.as_py()).encode())
                yield pa.RecordBatch.from_pydict({"file": [f"{stem}.warc.gz"], "members": [len(sidecar)]}, schema=arrow)

    return in_batches(archives.select("archive", "part", "content", "sidecar"), run, "file string, members long")


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each entry of the sidecars, read from its member alone; payloads are checked against their digests."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(urn: str | None) -> int | None:
        found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, sidecar in zip(batch.column("content"), batch.column("sidecar").to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                got: dict[str, list] = {c: [] for c in arrow.names}
                for x in sidecar:
                    fields, block = parse(zlib.decompress(view[x["offset"] : x["offset"] + x["length"]], 31))
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(_END)[2]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    for c, v in zip(arrow.names, (page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To"))), strict=True):
                        got[c].append(v)
                yield pa.RecordBatch.from_pydict(got, schema=arrow)

    return in_batches(archives.select("content", "sidecar"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its archives give them back.

    Null pages have an empty payload. Of equal payloads of 1000 bytes or more the largest page_id is the response; rows that
    repeat that id are responses too, and where no row has an id all are. Smaller payloads are always responses. An empty
    table gives no rows; other columns are ignored.
    """
    archives = staged(normalise(write_archives(with_originals(pages))), "warc")
    records = read_records(archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
