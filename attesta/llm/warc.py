"""WARC archives: writing with revisits and segments, and reading with reassembly.

A page becomes one ``response`` record, its payload in chunked transfer
framing, or a ``revisit`` of the response that has an equal payload.  A record
whose block exceeds ``segment_bytes`` is cut into a first segment and
``continuation`` records, as the WARC format says: they carry the first one's
identifier and their segment number, the last one also the total length.
Every record is a gzip member of its own.

Reading groups the segments by that identifier, orders them by number, checks
that none is missing and that the lengths add up to the total, joins them and
undoes the chunked framing.  Whole records skip the shuffle.  The payload's
SHA-1 is computed anew and compared with the header.

Files are written under names of their own for each attempt; a manifest that
Spark commits names those that count, and only these are read.

Defined results: a null payload is empty; of repeated rows one is the response
and the others revisit it; rows with a payload under ``min_revisit_bytes`` are
responses of their own; of equal payloads and page_ids the lesser url is the
response, null last; a page without an id or url is written without
that header (``refers_to`` is null if the response has no id); further columns
are ignored.  A damaged record gives a row whose ``error`` says what is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.arrowtools import runs, small_batches
from attesta.llm.salting import salted_join

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, url string, page_id long, refers_to long, payload_digest string, segment int, total_length long, block binary"
_PAGE = "record_id string, record_type string, url string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary, error string"


def chunked(payload: bytes, size: int) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size
        if len(out[-1]) != size or data[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def records_of(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, role: str, own: str, segment_bytes: int, chunk_bytes: int, date: str
) -> Iterator[bytes]:
    """The records of one page, in order.  ``role`` is first (the response that others may refer to), response or revisit; ``own`` is a name that no other record has."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    is_revisit = role == "revisit"
    first = _name(page_id, url, digest) if role == "first" else _name(own)
    headers = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", first), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to, refers_url, digest)), ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response")]
        yield _record(headers, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        yield _record(headers, block)
        return
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record([*headers, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _name(first, n)), ("WARC-Date", date), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", first)]
        yield _record(more + [("WARC-Segment-Total-Length", len(block))] * (n == len(parts)), part)


def _planned(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to, refers_url, role) of each page.

    Only digests that occur more than once, with their counts, are gathered; the
    pages join them, so payloads are not shuffled where these are few enough to
    broadcast, and a common digest's pages are dealt by salt where they are not.
    Rows that are equal altogether to the response, but one, are its revisits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    per = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    each = per.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("o"), "n")).alias("first")).where("n > 1")
    repeated = scratch.save(each.select("digest", "n", F.col("first.o.page_id").alias("f_id"), F.col("first.o.url").alias("f_url"), F.col("first.n").alias("alike")), "repeated")
    joined = salted_join(rows, repeated, "digest", "page_id", "url")
    known, small = F.col("n").isNotNull(), F.length("payload") < min_revisit_bytes
    is_first = F.col("page_id").eqNullSafe(F.col("f_id")) & F.col("url").eqNullSafe(F.col("f_url"))
    role = F.when(small, "response").when(~known | is_first, "first").otherwise("revisit")
    planned = joined.withColumn("role", role).withColumn("copies", F.when(known & is_first & ~small, F.col("alike")).otherwise(1))
    out = ["page_id", "url", "payload", F.col("f_id").alias("refers_to"), F.col("f_url").alias("refers_url"), "role"]
    single = planned.where("copies = 1").select(*out)
    if repeated.where("alike > 1").isEmpty():
        return single
    # Equal rows are counted, their payload kept once, and told apart by a number.
    alike = planned.where("copies > 1").groupBy("digest", "page_id", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    numbered = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("page_id", "url", "payload", F.col("page_id").alias("refers_to"), F.col("url").alias("refers_url"), F.when(F.col("copy") == 1, "first").otherwise("revisit").alias("role"))
    return single.unionByName(numbered)


def write(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, segment_bytes: int = 16384, chunk_bytes: int = 4096, file_bytes: int = 1 << 24, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to files under ``folder``; returns (file, records)."""
    spark = pages.sparkSession
    small_batches(spark)
    planned = _planned(pages, min_revisit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, at = pyarrow.fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        out, written, done, number = None, 0, [], 0
        attempt = f"{uuid.uuid4().hex}"
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None or written >= file_bytes:
                    if out is not None:
                        out.close()
                    done.append([f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0])
                    out, written = where.open_output_stream(f"{at}/{done[-1][0]}", compression=None), 0
                number += 1
                for record in records_of(*row, f"{attempt}/{number}", segment_bytes, chunk_bytes, date):
                    out.write(record)
                    written += len(record)
                    done[-1][1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])

    planned.mapInArrow(run, "file string, records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("file string, records long").parquet(f"{folder}/manifest")


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_stream(read: Callable[[int], bytes], window: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a stream of gzip members, read and inflated a window at a time."""
    rest = b""
    while rest or (rest := read(window)):
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof and (rest or (rest := read(window))):
            parts.append(packer.decompress(rest))
            rest = packer.unused_data
        raw = b"".join(parts)
        head = raw.index(b"\r\n\r\n")
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(raw[: head + 2])}
        yield headers, raw[head + 4 : head + 4 + int(headers["content-length"])]


def _records(segments: bool, opened: Callable[[str], object]):  # noqa: ANN202
    """Records of the files that a column names, those of segments or the whole ones; ``opened`` gives a file with ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, t) for n, t in zip(("record_id", "record_type", "url", "page_id", "refers_to", "payload_digest", "segment", "total_length", "block"),
                                    (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))]
        )
        whole = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                file = opened(batch.column(0)[i].as_py())
                for h, block in parse_stream(file.read):
                    segment = whole(h, "warc-segment-number")
                    if (segment is not None) != segments or h["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    digest = h.get("warc-payload-digest")
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), whole(h, "x-page-id"), whole(h, "x-refers-to-page-id"),
                                 digest and digest.removeprefix("sha1:"), segment, whole(h, "warc-segment-total-length"), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["record_id"]):
        rows = t.to_pylist()
        first, blocks = rows[0], [r["block"] for r in rows]
        total = next((r["total_length"] for r in reversed(rows) if r["total_length"] is not None), None)
        whole = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and total == sum(map(len, blocks))
        first |= {"block": b"".join(blocks) if whole else None, "segment": None, "total_length": total}
        yield from pa.Table.from_pylist([first], schema=t.schema).to_batches()


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = ["record_id", "record_type", "url", "page_id", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            out = []
            for r in batch.slice(lo, 500).to_pylist():
                payload = size = error = None
                try:
                    if r["block"] is None:
                        raise ValueError("segments are missing or don't add up")
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    http = {k.lower(): v for k, v in _HEADER.findall(head + b"\r\n")}
                    if r["record_type"] == "revisit":
                        size = int(http[b"content-length"]) if b"content-length" in http else None
                    else:
                        payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != r["payload_digest"]:
                            raise ValueError("the payload differs from its digest")
                except ValueError as e:
                    error = str(e)
                out.append((r["record_id"], r["record_type"], r["url"], r["page_id"], r["refers_to"], r["payload_digest"], size, payload, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page of the archives that the manifest under ``folder`` names: its record's fields, payload (null for revisits), payload_bytes and error."""
    manifest = spark.read.schema("file string, records long").parquet(f"{folder}/manifest").select("file")
    files = manifest.repartition(max(1, min(manifest.count(), 10_000)))

    def opened(name: str) -> object:
        where, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
        return where.open_input_stream(at, compression=None)

    single = files.mapInArrow(_records(False, opened), _RECORD)
    cut = files.mapInArrow(_records(True, opened), _RECORD)
    joined = cut.repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(_reassembled, _RECORD)
    return single.unionByName(joined).mapInArrow(_decoded, _PAGE)


def archive_and_read(pages: DataFrame, **options: int) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch.new_path(spark, "warc")
    write(pages, folder, **options)
    return read(spark, folder)
