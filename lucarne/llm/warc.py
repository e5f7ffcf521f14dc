"""WARC archives: a parallel writer and a sequential reader.

Every record is a gzip member of its own. The reader streams an archive: it feeds compressed chunks to one zlib object per
member, frames the record by its content length, and recomputes the block and payload digests while the bytes come in; a
record with a wrong digest, length or member is an error. A task holds one record at a time.

Writing tasks name their files after the attempt and return the names; only names that Spark has committed are read, so
attempts that died or ran twice leave nothing behind in the result. Archives are closed at ``max_bytes``. Files are opened with
pyarrow, which knows local paths and the common object stores.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = 1 << 16
ROW = "urn:x-row:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is damaged or not framed as its header says."""


def _file_system(path: str) -> tuple[FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


# -- writing


def _clean(text: str) -> str:
    """Control characters of a header value, percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = f"{ROW}{key}" if key is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url}#{digest}").urn
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ROW}{refers_to}>"]
    head += [
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(df: DataFrame, key: str, payload: str, least: int = 100) -> DataFrame:
    """Columns key, url, payload, digest, refers_to and revisit for every row.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key is the response; rows that share
    that key are responses too, and so are all rows of a payload that has no key. Only digests and keys are grouped; a payload
    with many copies is one row per task before the shuffle, and the join back leaves out payloads without copies.
    """
    named = df.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    first = named.where(long).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    alone = F.concat(F.lit("-"), F.xxhash64(key, "url").cast("string"))  # short payloads match nothing and spread
    joined = named.withColumn("digest_key", F.when(long, F.col("digest")).otherwise(alone)).join(
        first.select(F.col("digest").alias("digest_key"), "first"), "digest_key", "left"
    )
    revisit = F.coalesce(~F.col(key).eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return joined.select(key, "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", max_bytes: int = 32 << 20) -> DataFrame:
    """Write a record per row below ``path``; the archives as rows of path, records and bytes (evaluate it once, and keep it).

    Payloads are binary or text in UTF-8; null and empty ones are records without payload. Null keys get a record id made of
    url and digest, null urls no target. An empty table writes no archive.
    """
    rows = with_roles(df.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ), "key", "payload")
    root = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(root)
        system.create_dir(folder, recursive=True)
        stream: BinaryIO | None = None
        name, records, size, done = "", 0, 0, []

        def close() -> None:
            if stream is not None:
                stream.close()
                done.append((name, records, size))

        for batch in batches:
            for row in _rows(batch):
                if stream is None or size >= max_bytes:
                    close()
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(*row)) + packer.flush()
                stream.write(member)
                records, size = records + 1, size + len(member)
        close()
        if done:
            names, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}" for n in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records long, bytes long")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row by row, so that payloads are copied one at a time."""
    key, url, payload, digest, refers_to, revisit = batch.columns
    for i in range(batch.num_rows):
        yield key[i].as_py(), url[i].as_py(), payload[i].as_py(), digest[i].as_py(), refers_to[i].as_py(), revisit[i].as_py()


# -- reading


class _Member:
    """The uncompressed bytes of one gzip member, pulled from the archive chunk by chunk."""

    def __init__(self, read: Callable[[], bytes], held: bytes):
        self.read, self.held, self.inflate, self.out = read, held, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.held or self.read()
        self.held = b"" if not self.inflate.unconsumed_tail else self.held
        if not data:
            raise WarcError("the archive ends inside a record")
        try:
            self.out += self.inflate.decompress(data, CHUNK)
        except zlib.error as error:
            raise WarcError(f"damaged member: {error}") from error
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``; a header is as long as its address, which has no bound."""
        begin = 0
        while (at := self.out.find(mark, begin)) < 0:
            begin = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise WarcError("a header without end")
        head, self.out = self.out[:at], self.out[at + len(mark):]
        return head

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.out and not self.more():
                raise WarcError("a block shorter than its content length")
            part, self.out = self.out[:count], self.out[count:]
            count -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            if len(self.out) > 4:
                break
        return self.out


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(read: Callable[[], bytes], payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, in order; ``read`` gives the next chunk, empty at the end."""
    held = b""
    while True:
        held = held or read()
        if not held:
            return
        member = _Member(read, held)
        version, head = _fields(member.until(b"\r\n\r\n"))
        if not version.startswith("WARC/") or not head.get("content-length", "").isdigit():
            raise WarcError(f"not a record: {version[:40]!r}")
        block, body, kept, seen, http = hashlib.sha256(), hashlib.sha256(), [], 0, None
        is_http = head.get("content-type", "").startswith("application/http")
        start = b""
        for part in member.take(int(head["content-length"])):
            block.update(part)
            if is_http and http is None:
                start += part
                if b"\r\n\r\n" not in start:
                    continue
                lead, _, part = start.partition(b"\r\n\r\n")
                http = _fields(lead)[1]
            body.update(part)
            seen += len(part)
            if payloads:
                kept.append(part)
        if is_http and http is None:
            raise WarcError("an HTTP block without a header end")
        if member.rest() != b"\r\n\r\n":
            raise WarcError("a record that does not end where its length says")
        revisit = head.get("warc-type") == "revisit"
        for name, digest in (("warc-block-digest", block), ("warc-payload-digest", body)):
            said = head.get(name, "")
            if said.startswith("sha256:") and not (revisit and name == "warc-payload-digest") and said != f"sha256:{digest.hexdigest()}":
                raise WarcError(f"wrong {name}")
        refers = head.get("warc-refers-to", "").strip("<>")
        own = head.get("warc-record-id", "").strip("<>")
        length = (http or {}).get("content-length", "")
        yield {
            "record_id": own, "record_type": head.get("warc-type"), "url": head.get("warc-target-uri"),
            "key": int(own.removeprefix(ROW)) if own.startswith(ROW) else None,
            "refers_to": int(refers.removeprefix(ROW)) if refers.startswith(ROW) else None,
            "payload_bytes": int(length) if revisit and length.isdigit() else seen,
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else body.hexdigest(),
            "payload": None if revisit or not payloads else b"".join(kept),
        }
        held = member.inflate.unused_data
        if not member.inflate.eof:
            raise WarcError("a member that does not end")
        held += member.held


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("key", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def read(spark: SparkSession, archives: DataFrame, files: int, payloads: bool = True, path: str = "path") -> DataFrame:
    """All records of the archives named in ``archives``, one task per archive (``files`` tells how many there are).

    ``key`` and ``refers_to`` are those of ``write``, null for other record ids; ``payload_bytes`` and ``payload_digest``
    describe the whole payload, also of revisits, whose ``payload`` is null. Null paths are skipped. SHA-256 digests are
    verified; a revisit's payload digest belongs to another record and is passed on.
    """
    arrow = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, file = _file_system(name)
                with system.open_input_stream(file, compression=None) as stream:
                    rows, size = [], 0
                    for record in read_records(lambda: stream.read(CHUNK), payloads):
                        rows.append(record)
                        size += 300 + len(record["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.where(F.col(path).isNotNull()).select(path).repartition(max(1, files), path).mapInArrow(run, RECORD)
