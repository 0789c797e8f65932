"""WARC archives: one gzip member per record, written and read sequentially, after the public WARC 1.1 format."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm.common import small, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The records carry no crawl time of their own; all get this date.
DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = 0x6279_7465_6C61_8B65  # upper half of our record ids
_NONE = _NAMESPACE ^ 1
#: Digests (some 100 bytes each) that are sent to every executor at most; more of them are joined by a shuffle.
SHARED_ROWS = 200_000


def digest(data: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN from which the page id can be read back."""
    value = _NONE << 64 if page_id is None else _NAMESPACE << 64 | page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_id_of(urn: str | None) -> int | None:
    """None for other writers' ids."""
    try:
        value = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    low = value & (1 << 64) - 1
    return None if value >> 64 != _NAMESPACE else low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str, payload: bytes, payload_digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only; its payload is that of the record it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = "".join(c for c in url if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None

    @property
    def kind(self) -> str | None:
        return self.headers.get("warc-type")

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of an HTTP response block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), body


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    """Lower-cased names; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes that are tried to see whether a record starts there.
PROBE = 4096


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member that starts with these bytes holds a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def members(chunks: Iterable[bytes], step: int = 1 << 14) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, content, error) of each gzip member of a stream of chunks. A bad member ends where the next one that holds a WARC record starts; it is sought from behind the bad one's first byte.

    At most one member is held at a time, with its compressed bytes, so that a bad one can be searched.
    """
    source, held, base = iter(chunks), bytearray(), 0  # held starts at the stream's byte base
    begin, at, ended, seeking, unzip, content = 0, 0, False, False, None, []
    while True:
        if seeking:
            found = held.find(MAGIC, at)
            if found >= 0 and (ended or len(held) - found >= PROBE):
                seeking = not _starts_record(bytes(held[found : found + PROBE]))
                at = found + seeking
                continue
            if ended:
                return
            at = found if found >= 0 else max(at, len(held) - len(MAGIC) + 1)
        elif at < len(held):
            if unzip is None:
                unzip, content, begin = zlib.decompressobj(31), [], at
            part = bytes(held[at : at + step])
            try:
                content.append(unzip.decompress(part))
            except zlib.error as e:
                yield base + begin, b"".join(content), f"bad gzip data: {e}"
                unzip, seeking, at = None, True, begin + 1
                continue
            at += len(part) - len(unzip.unused_data)
            if unzip.eof:
                yield base + begin, b"".join(content), None
                unzip = None
            continue
        elif ended:
            if unzip is None:
                return
            yield base + begin, b"".join(content), "the last member is cut off"
            unzip, seeking, at = None, True, begin + 1  # what follows a bad length may have been taken for part of it
            continue
        chunk = next(source, None)
        ended = chunk is None
        gone = at if unzip is None else begin
        del held[:gone]
        base, at, begin = base + gone, at - gone, begin - gone
        held += chunk or b""


def _parsed(offset: int, data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        return Record(offset, error="no WARC header")
    out = Record(offset, _headers(lines[1:]))
    size = out.headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        out.error = "no content length"
        return out
    out.block = rest[: int(size)]
    if len(out.block) < int(size) or rest[int(size) :] != b"\r\n\r\n":
        out.error = "the block is not as long as its content length says"
    elif (got := _checked(out.headers.get("warc-block-digest"), out.block)) is not None:
        out.error = f"block digest differs: {got}"
    elif out.kind == "response" and (got := _checked(out.headers.get("warc-payload-digest"), out.http()[1])) is not None:
        out.error = f"payload digest differs: {got}"
    return out


def _checked(said: str | None, data: bytes) -> str | None:
    """None if the digest holds or is of another kind, else what it is."""
    kind, _, value = (said or "").partition(":")
    return None if kind.lower() != "sha1" or digest(data) == value.upper() else digest(data)


def read(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive in their order. A record that breaks framing or a digest comes with its error, and reading goes on with the next member."""
    for offset, data, error in members(chunks):
        yield _parsed(offset, data) if error is None else Record(offset, error=error)


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", target_bytes: int = 8_000_000) -> DataFrame:
    """Archives of one record per page: (archive, content), each closed at the first record past target_bytes.

    Only the digests of payloads that several pages share are joined back to the pages, so payloads are not moved while these are at most SHARED_ROWS (counted first).

    Of pages with equal payloads (html in UTF-8; null is empty), that with the largest id is the response and the others are revisits
    of it. Rows that repeat this id are responses too; a null id comes before every other. A null URL is empty. Other columns are ignored; an empty table gives no archives.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = base.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last", F.lit(True).alias("again"))
    # written: it is counted, and where it is large, AQE may split a payload that many pages share
    shared = small(written(shared, "payloads"), SHARED_ROWS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}"]), pa.array([b"".join(out)], pa.binary())], names=["archive", "content"])
        for batch in batches:
            for page, url, payload, to in zip(*(batch.column(k) for k in range(4)), strict=True):
                page, to, data = page.as_py(), to.as_py(), payload.as_py()
                out.append(record(page, url.as_py(), data, digest(data), to, revisit=page != to))
                size += len(out[-1])
                if size >= target_bytes:
                    yield row()
                    number, out, size = number + 1, [], 0
        if out:
            yield row()

    last = F.when(F.col("again"), F.col("last")).otherwise(F.col("page_id")).alias("last")
    return base.join(shared, "key", "left").select("page_id", "url", "payload", last).mapInArrow(part, "archive string, content binary")


RECORDS = "archive string, offset long, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def _rows(name: str, found: Iterable[Record], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records of one archive as batches of RECORDS, of some 4 MB of payload each."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    rows, size = [], 0
    for r in found:
        http, payload = r.http()
        said = r.headers.get("warc-payload-digest", "").partition(":")[2] or None
        length = http.get("content-length", "") if r.kind == "revisit" else str(len(payload))
        rows.append(
            (
                name, r.offset, page_id_of(r.headers.get("warc-record-id")), r.kind, r.headers.get("warc-target-uri"), int(length) if length.isdigit() else None,
                said, page_id_of(r.headers.get("warc-refers-to")), payload if with_payload and r.kind == "response" else None, r.error,
            )
        )
        size += len(payload)
        if size > 4_000_000:
            yield flush(rows)
            rows, size = [], 0
    if rows:
        yield flush(rows)


def records(found: DataFrame, name_col: str = "archive", content_col: str = "content", with_payload: bool = True) -> DataFrame:
    """Records of archives (name, content), in the columns RECORDS.

    Every block digest, and every response's payload digest, is verified. payload_bytes and payload_digest are those of the full
    payload, for revisits as their headers give them. A faulty record has an error and is otherwise as far as it could be read. Null content gives no records.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _rows(name.as_py(), read([content.as_py() or b""]), with_payload)

    return found.select(name_col, content_col).mapInArrow(part, RECORDS)


def _stream(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of a file by its URI, in any file system that Arrow reads."""
    from urllib.parse import unquote, urlsplit

    from pyarrow import fs

    if path.startswith("file:"):
        system, where = fs.LocalFileSystem(), unquote(urlsplit(path).path)
    else:
        system, where = fs.FileSystem.from_uri(path)
    with system.open_input_stream(where, compression=None) as f:
        while chunk := f.read(size):
            yield chunk


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the .warc.gz files under a path, in the columns RECORDS. Files are streamed in chunks, so they may be of any size: only one record at a time is held whole."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _rows(name, read(_stream(name)), with_payload)

    return listed.mapInArrow(part, RECORDS)
