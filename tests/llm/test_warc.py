import gzip  # noqa: F401
import hashlib
import random

import pytest

from chronogrid.llm import warc
from chronogrid.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, number int"


def pages(spark):
    rng = random.Random(4)
    same = "<p>" + "gleich und lang " * 90
    evil = "x" * 990 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = [(i, f"http://h/{i}", "".join(rng.choice("abé\n\r中<> ") for _ in range(rng.randint(0, 9000)))) for i in range(20)]
    data += [(30 + i, None, same) for i in range(4)] + [(40, "u", None), (41, "u", ""), (42, "u", "short"), (43, "u", "short"), (50, "u", evil), (51, "u", evil + "!"), (None, "u", same), (60, "a\r\nb", "z" * 70000)]
    return data, spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA).repartition(3)


def test_round_trip(spark):
    data, df = pages(spark)
    out = warc.round_trip(df, segment_bytes=4096, chunk_bytes=700, records_per_file=5).collect()
    assert len(out) == len(data)
    by = {r.page_id: r for r in out}
    largest = {}
    for p, _, html in data:
        if p is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(p, largest.get(html, -1))
    for p, _, html in data:
        raw = (html or "").encode()
        other = largest.get(html) if p is not None and len(raw) >= 1000 and largest[html] != p else None
        r = by[p]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other is not None else "response", other)


def test_payloads_byte_for_byte(spark):
    data, df = pages(spark)
    path = new_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=1000, chunk_bytes=300)
    kinds = {r.record_type for r in warc.read_records(spark, path).select("record_type").collect()}
    assert kinds == {"response", "revisit", "continuation"}
    got = sorted(bytes(r.payload) for r in warc.read_warc(spark, path).where("record_type = 'response'").collect())
    same = data[20][2]
    want = sorted((h or "").encode() for p, _, h in data if not (h == same and p in (30, 31, 32)))
    assert got == want


def test_empty_and_repeated(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    row = (7, "u", "r" * 2000, "", 0)
    out = warc.round_trip(spark.createDataFrame([row, row, (8, "v", "r" * 2000, "", 0)], SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [(7, "revisit", 8), (7, "revisit", 8), (8, "response", None)]


def test_framing():
    raw = "añ中".encode() * 50
    assert warc.unchunked(warc.chunked(raw, 7)) == raw and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"abc", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.joined([(2, 6, b"def"), (1, None, b"abc")], "o") == b"abcdef"
    for bad in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(ValueError):
            warc.joined(bad, "o")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
