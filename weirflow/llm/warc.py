"""WARC archives: writing captures, and transaction assembly on reading.

A capture is three records, request, response (or revisit) and metadata; the
first and last name the second by ``WARC-Concurrent-To``. Archives are written by
Spark's own text writer, whose line separator is the two line ends that close
a WARC record, so any store that Spark reaches can hold them. Reading parses
each gzip file as a stream by ``Content-Length``, groups records by the
identifier they are concurrent to, and emits one nested row per capture.

Of captures with equal payloads of at least ``least`` bytes, that of the largest id
(then URL) is the response; the others are revisits that refer to it.

Defined results: a null payload is empty; a null URL leaves its header out;
null ids and URLs rank below all others and are null again on reading; rows that repeat id, URL and
payload are captures of their own, each with the record type of the first; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import shared_dir, small_batches, written

LEAST = 0
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive file before compression, about.
FILE_BYTES = 32 << 20
#: Up to so many groups of equal payloads their owners are broadcast: about 200 bytes each.
BROADCAST_GROUPS = 100_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def _record_id(kind: str, page, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {page} {digest} {url}')}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: str) -> str:
    size = len(block.encode())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {size}", "", block])


def _capture(page, url, html: str, owner) -> list[str]:
    """The three records of a capture; ``owner`` is (id, URL) of the response that it revisits, or None."""
    body = html.encode()
    raw = hashlib.sha1(body)
    digest, main_id = f"sha1:{base64.b32encode(raw.digest()).decode()}", _record_id("response", page, url, raw.hexdigest())
    uri = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    target = ("WARC-Target-URI", uri)
    host = re.sub(r"^[a-z]+://([^/?#]*).*", r"\1", uri or "")
    request = _record("request", _record_id("request", page, url, raw.hexdigest()), [target, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/http; msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n")
    head = (_HTTP % len(body)).decode()
    if owner is None:
        main = _record("response", main_id, [target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], head + html)
    else:
        refers = [("WARC-Refers-To", _record_id("response", *owner, raw.hexdigest())), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = _record("revisit", main_id, [target, *refers, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], head)
    fields = [("page", page), ("payloadLength", len(body)), ("refersToPage", None if owner is None else owner[0])]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return [request, main, _record("metadata", _record_id("metadata", page, url, raw.hexdigest()), [target, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/warc-fields")], about)]


def _records(batches):
    for rows in batches:
        out: list[str] = []
        for page, url, html, revisits, owner, owner_url in zip(*(rows.column(k).to_pylist() for k in range(6)), strict=True):
            out += _capture(page, url, html, (owner, owner_url) if revisits else None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, key="page_id", url="url", payload="html", least: int = LEAST) -> None:
    """Write one capture per row of ``pages`` as gzip WARC files in the folder ``path``."""
    small_batches(pages.sparkSession)
    base = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    ranked = F.struct("page", "url")
    groups = base.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max(ranked).alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
    groups = written(groups, "payloads")
    about = groups.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > 1).alias("shared")).first()
    owners = groups.filter("n > 1").select(F.col("digest").alias("of"), "first")
    owners = F.broadcast(owners) if about.shared <= BROADCAST_GROUPS else owners
    first = F.col("first.page").eqNullSafe(F.col("page")) & F.col("first.url").eqNullSafe(F.col("url"))
    rows = base.join(owners, (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left")
    rows = rows.select("page", "url", "html", F.coalesce(F.col("of").isNotNull() & ~first, F.lit(False)).alias("revisits"), F.col("first.page").alias("owner"), F.col("first.url").alias("owner_url"))
    records = rows.mapInArrow(_records, "value string")
    each = max(1.0, (about.bytes or 0) / max(1, about.rows or 0)) + 1500
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * max(16, int(FILE_BYTES / each))).text(path)


class _Stream:
    """Bytes of a gzip (or plain) file, inflated as they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held = raw, 0, bytearray()
        self.codec = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        while self.codec is not None and piece:
            self.held += self.codec.decompress(piece)
            piece = self.codec.unused_data
            if self.codec.eof:  # the next gzip member
                self.codec = zlib.decompressobj(31)
        if self.codec is None:
            self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a WARC record ends before its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_ends(self) -> None:
        while len(self.held) < 4 and self.more():
            pass
        while self.held[:1] in (b"\r", b"\n"):
            del self.held[:1]
            if not self.held:
                self.more()


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file."""
    stream = _Stream(raw)
    while True:
        stream.skip_ends()
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, stream.take(int(headers["content-length"]))


_FIELDS = "capture string, kind string, record_id string, uri string, date string, refers_to string, digest string, payload_bytes long, payload binary, page long, meta_bytes long, refers_page long"
_TYPES = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _read(with_payload: bool):
    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, own = headers["warc-type"], headers["warc-record-id"]
        payload = size = digest = page = meta_bytes = refers_page = None
        if kind in ("response", "revisit"):
            body = block.partition(b"\r\n\r\n")[2]
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response":
                size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                payload = body if with_payload else None
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            page, meta_bytes, refers_page = (int(fields[k]) if k in fields else None for k in ("page", "payloadLength", "refersToPage"))
        return (headers.get("warc-concurrent-to", own), kind, own, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), digest, size, payload, page, meta_bytes, refers_page)

    def run(batches):
        for files in batches:
            for raw in files.column(0):
                out, held = [], 0
                for headers, block in parse(raw.as_py()):
                    out.append(row(headers, block))
                    held += len(block) if with_payload else 0
                    if len(out) >= 3000 or held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return run


def read_captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: capture, request, response and metadata structs.

    ``response.kind`` tells responses from revisits; a revisit's payload is null and
    its length comes from the metadata record. A missing record is a null struct.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(_read(with_payload), _FIELDS)
    # Rows that repeat all their fields share identifiers; their records are told apart by number.
    role = F.when(F.col("kind").isin("response", "revisit"), "response").otherwise(F.col("kind"))
    numbered = records.withColumn("role", role).repartition("capture").withColumn("n", F.row_number().over(Window.partitionBy("capture", "role").orderBy("record_id")))

    def of(role: str, *fields: str):
        return F.max_by(F.struct(*fields), F.lit(1)) if role is None else F.max_by(F.when(F.col("role") == role, F.struct(*fields)), F.when(F.col("role") == role, F.lit(1)))

    return numbered.groupBy("capture", "n").agg(
        of("request", "record_id", "uri", "date").alias("request"),
        of("response", "record_id", "kind", "uri", "refers_to", "digest", "payload_bytes", "payload").alias("response"),
        of("metadata", "record_id", "page", "meta_bytes", "refers_page").alias("metadata"),
    )


def round_trip(pages: DataFrame, key="page_id", url="url", payload="html", least: int = LEAST, with_payload: bool = True) -> DataFrame:
    """Captures of ``pages`` written to archives in the shared folder and read back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key, url, payload, least)
    return read_captures(pages.sparkSession, path, with_payload)


def capture_digests(captures: DataFrame, key="page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each capture."""
    return captures.select(
        F.col("metadata.page").alias(key),
        F.coalesce("response.payload_bytes", "metadata.meta_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(F.col("response.kind") == "revisit", F.col("metadata.refers_page")).alias("refers_to"),
    )
