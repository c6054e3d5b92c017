"""WARC archives: writing with revisits, segments and chunked framing; reading with segment reassembly.

Writing.  A page is a response record whose block is an HTTP response with the payload in chunked transfer
framing; of pages with equal payloads of at least `revisit_bytes` the one with the largest page_id is the
response and the others are revisits that refer to it.  A block longer than `segment_bytes` is cut into a
first record and continuation records with WARC-Segment-Number, WARC-Segment-Origin-ID and, on the last,
WARC-Segment-Total-Length.  Spark's text writer puts the records into files of the shared folder (a record's
two final line ends are its line separator), so commits, retries and remote stores are Spark's.

Reading.  Files are parsed by Content-Length.  Segmented records are grouped by origin identifier (only these
are shuffled), ordered by number and joined; a gap, a repeat or a wrong total length raises.  The chunked
framing is then decoded and the payload's length and digest taken from its bytes.

A file holds at most `records_per_file` pages; a task holds one file, and one record.

Defined results: null html is an empty payload; null url is written as an empty target; a null page_id is read
back as null and is never referred to; equal rows become records of their own (several with the largest
page_id are all responses); a payload of any length is written and read by one task, in segments; an empty table
gives an empty archive; other columns, clashing names included, are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize, new_path

VERSION = "WARC/1.1"
REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 1000, 16 << 10, 4 << 10, 2000
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HTTP_TYPE = "application/http; msgtype=response"
_RECORD = "record_id string, record_type string, refers_to string, digest string, origin string, number int, total long, block binary"


def cut(raw: bytes, size: int) -> list[bytes]:
    """Pieces of about `size` bytes that end where a character does (the writer takes text)."""
    out, lo = [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + size)
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        out.append(raw[lo:hi])
        lo = hi
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in cut(payload, size)) + b"0\r\n\r\n"


def unchunked(raw: bytes) -> bytes:
    """Decode chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(raw[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = raw[end + 2 : end + 2 + size]
        if len(part) != size or raw[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def joined(parts: list[tuple[int, int | None, bytes]], origin: str) -> bytes:
    """The block of a segmented record from (number, total, bytes) in any order, with everything verified."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"{origin}: segments {[p[0] for p in parts]}")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError(f"{origin}: {len(block)} bytes, not {parts[-1][1]}")
    return block


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def _records(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, unique, refers in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "html", "unique", "refers_to")), strict=True):
                payload = (html or "").encode()
                me = f"<urn:page:{page}:{unique}>"
                fields = [("WARC-Record-ID", me), ("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("Content-Type", _HTTP_TYPE)]
                if refers is not None:
                    head = _HEAD
                    out.append(_record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")], head))
                    continue
                parts = cut(_HEAD + chunked(payload, chunk_bytes), segment_bytes)
                if len(parts) == 1:
                    out.append(_record([("WARC-Type", "response"), *fields], parts[0]))
                    continue
                out.append(_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    total = [("WARC-Segment-Total-Length", sum(map(len, parts)))] if k == len(parts) else []
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{unique}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k), *total], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    revisit_bytes: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write `pages` (page_id, url, html) to WARC files under `path`."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("n"))
    # payloads that occur again: a row each, however often
    again = digests.where((F.col("n") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c")).where("c > 1").select("digest", "response")
    again = broadcast_if_small(materialize(again, "again"))
    marked = pages.withColumn("digest", F.sha1(F.encode(html, "utf-8"))).join(again, "digest", "left")
    other = F.when((F.col("page_id") != F.col("response")) & (F.octet_length(html) >= revisit_bytes), F.col("response"))
    rows = marked.select("page_id", "url", "html", F.expr("uuid()").alias("unique"), other.alias("refers_to"))
    records = rows.mapInArrow(_records(segment_bytes, chunk_bytes), "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse(raw: bytes) -> Iterator[dict]:
    """The records of a WARC file: header fields in lower case, and `block`."""
    at, n = 0, len(raw)
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= n:
            return
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        fields: dict = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        fields["block"] = raw[end + 4 : end + 4 + length]
        if len(fields["block"]) != length:
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields
        at = end + 4 + length


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for raw in batch.column("content"):
            rows: list[tuple] = []
            size = 0
            for f in parse(raw.as_py()):
                number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-refers-to"), f.get("warc-payload-digest"), f.get("warc-segment-origin-id"), number and int(number), total and int(total), f["block"]))
                size += len(f["block"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it stands in the files, segments separate."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, _RECORD)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for me, parts in zip(batch.column("record_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            block = parts[0]["block"] if parts[0]["number"] is None else joined([(p["number"], p["total"], p["block"]) for p in parts], me)
            out.append(payload_of(block))
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("record_id", "record_type", "refers_to", "digest")] + [pa.array(out, pa.binary())], names=["record_id", "record_type", "refers_to", "digest", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers_to, digest and payload of each record, segments reassembled.

    A revisit's payload is what its own block holds: none.
    """
    records = read_records(spark, path)
    part = F.struct("number", "total", "block")
    kinds = F.col("record_type").isin("response", "revisit", "resource")
    whole = records.where(kinds & F.col("number").isNull()).select("record_id", "record_type", "refers_to", "digest", F.array(part).alias("parts"))
    segments = records.where(F.col("number").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    grouped = segments.groupBy("origin").agg(F.max(F.when(F.col("number") == 1, F.struct("record_type", "refers_to", "digest"))).alias("f"), F.collect_list(part).alias("parts"))
    grouped = grouped.select(F.col("origin").alias("record_id"), "f.record_type", "f.refers_to", "f.digest", "parts")
    body = lambda df: df.mapInArrow(_payloads_or_empty, "record_id string, record_type string, refers_to string, digest string, payload binary")
    return body(whole).union(body(grouped))


def _payloads_or_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads; a revisit's block is a response head without a body."""
    for batch in batches:
        revisit = [x == "revisit" for x in batch.column("record_type").to_pylist()]
        own = pa.array(revisit)
        yield from _payloads(iter([batch.filter(pa.compute.invert(own))]))
        rest = batch.filter(own)
        empty = pa.array([b""] * rest.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([rest.column(x) for x in ("record_id", "record_type", "refers_to", "digest")] + [empty], names=["record_id", "record_type", "refers_to", "digest", "payload"])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from archives.

    A response's figures are taken from its reassembled bytes and its digest field is verified against them;
    a revisit's come from the response that it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, **options)
    number = lambda name: F.regexp_extract(name, r"^<urn:page:(\d+|-\d+)", 1)
    id_of = lambda name: F.when(number(name) != "", number(name).cast("long"))
    found = read_warc(spark, path).select(
        id_of("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        id_of("refers_to").alias("refers_to"),
        F.regexp_extract("digest", r"^sha1:(.*)$", 1).alias("stated"),
    )
    found = materialize(found, "records")
    responses = found.where("record_type = 'response'")
    wrong = F.raise_error(F.concat(F.lit("payload digest differs on page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    responses = responses.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(wrong))
    revisits = found.where("record_type = 'revisit'").select("page_id", "refers_to", "stated")
    sources = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes"), F.col("payload_digest")).dropDuplicates(["refers_to", "payload_digest"])
    same = revisits.join(sources, (revisits.refers_to == sources.refers_to) & (revisits.stated == sources.payload_digest)).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), revisits.refers_to)
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(same)


def oracle_sql(revisit_bytes: int = REVISIT_BYTES) -> str:
    """The same in DuckDB SQL, for unique page_ids."""
    return f"""
    with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as n, sha1(coalesce(html, '')) as digest from pages),
    r as (select digest, max(page_id) as response from p where n >= {revisit_bytes} group by 1)
    select p.page_id, p.n as payload_bytes, p.digest as payload_digest,
      case when r.response is not null and p.page_id <> r.response and p.n >= {revisit_bytes} then 'revisit' else 'response' end as record_type,
      case when p.page_id <> r.response and p.n >= {revisit_bytes} then r.response end as refers_to
    from p left join r on p.digest = r.digest"""
