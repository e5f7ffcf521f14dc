"""Archives written and read back, and what the reader refuses."""

import glob
import gzip
import hashlib
import io

import pytest

from lucarne.llm.queries import op3_warc
from lucarne.llm.warc import WarcError, read, read_records, record_bytes, write

COPY, LONG = "copy " * 40, "é" * 400_000
PAGES = [
    (5, "http://a/", COPY), (3, "http://b/\r\nX: y", COPY), (9, None, COPY), (None, "http://n/", COPY), (7, "u", "short"), (8, "u", "short"),
    (1, "u", None), (2, "u", ""), (4, "u", LONG), (6, "http://é/", "ü" * 60), (10, "u", "no key " * 30), (11, "u", "x" * 99), (12, "u", "x" * 99),
    (13, "u", "y" * 100), (14, "u", "y" * 100), (15, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (20, "u", "z" * 200), (20, "u", "z" * 200), (21, "u", "z" * 200),
    (22, "http://long/" + "u" * 2_000_000, "v" * 150), (23, "http://long/" + "u" * 2_000_000, "v" * 150), (None, "v", "w" * 300), (None, "w", "w" * 300),
]
SCHEMA = "page_id long, url string, html string"


def expected():
    first = {}
    for key, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and key is not None:
            first[raw] = min(first.get(raw, key), key)
    for key, _, html in PAGES:
        raw = (html or "").encode()
        revisit = raw in first and first[raw] != key
        yield key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None


def order(rows):
    return sorted(rows, key=repr)


def test_round_trip(spark, tables, tmp_path):
    df = spark.createDataFrame([(*p, "k", "d") for p in PAGES], f"{SCHEMA}, key string, digest string").repartition(3)
    archives = write(df, f"file://{tmp_path}/w", max_bytes=400).collect()
    assert sum(a.records for a in archives) == len(PAGES) and len(archives) > 3
    names = spark.createDataFrame([(a.path,) for a in archives] + [(None,)], "path string")
    got = read(spark, names, len(archives)).collect()
    assert order((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == order(expected())
    payloads = {(k, h or "") for k, _, h in PAGES}
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else (r.key, bytes(r.payload).decode()) in payloads
    assert {r.url for r in got} >= {None, "http://b/%0D%0AX: y", "http://é/"}
    # Any gzip tool reads an archive as a whole.
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.warc.gz"))
    assert raw.count(b"WARC-Type: ") == len(PAGES)


def test_query(spark, tables):
    df = spark.createDataFrame(PAGES, SCHEMA)
    got = op3_warc(spark, tables(pages=df))
    assert order(map(tuple, got.collect())) == order(expected())
    assert op3_warc(spark, tables(pages=df.limit(0))).count() == 0


def chunks(raw, size=7):
    stream = io.BytesIO(raw)
    return lambda: stream.read(size)


def member(raw):
    return gzip.compress(raw, mtime=0)


ONE = record_bytes(1, "http://a/", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None, False)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_chunks_of_any_size(size):
    two = member(ONE) + member(record_bytes(2, None, b"", hashlib.sha256(b"").hexdigest(), None, False))
    assert [r["key"] for r in read_records(chunks(two, size))] == [1, 2]
    assert list(read_records(chunks(b"", size))) == []


@pytest.mark.parametrize("raw", [
    member(ONE)[:-30], member(ONE.replace(b"payloadpay", b"payloadPAY")), member(ONE[:-1]), member(ONE + b"x"), member(b"HTTP/1.1 200\r\n\r\n"),
    member(ONE.replace(b"Content-Length: 4", b"Content-Length: 9")), member(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), b"no gzip at all", member(b"WARC/1.1"),
])
def test_damage_is_an_error(raw):
    with pytest.raises(WarcError):
        list(read_records(chunks(raw)))


def test_other_records():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (r,) = read_records(chunks(member(info)))
    assert (r["record_type"], r["key"], r["payload"], r["payload_bytes"]) == ("warcinfo", None, b"hello", 5)
