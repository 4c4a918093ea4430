"""WARC archives: write captures as records, read archives, assemble transactions.

A capture is written as a response (or revisit), a request and a metadata record; the last two name
the first in WARC-Concurrent-To. Reading parses the records of each archive in order, by their
Content-Length, and joins the three kinds of a capture through that identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labreports.llm.common import own_exchange

# Fixed values of the WARC/1.1 format.
_VERSION = "WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

_NAMESPACE = uuid.UUID("9a0f4a54-6a52-4d6e-9d61-4c4b7d3f4a10")
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{name}')}>"


def _record(headers: list[tuple[str, str]], block: str) -> str:
    lines = [_VERSION, *(f"{name}: {value}" for name, value in headers)]
    lines.append(f"Content-Length: {len(block.encode('utf-8'))}")
    return "\r\n".join(lines) + _END + block


def _line(value: str | None) -> str:
    """A header value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def capture_records(page_id: object, url: str | None, payload: str, refers_to: object) -> list[str]:
    """The three records of one capture, without the blank lines that end a record."""
    target, size = _line(url), len(payload.encode("utf-8"))
    digest = f"sha1:{payload_digest(payload.encode('utf-8'))}"
    kind = "response" if refers_to is None else "revisit"
    # A page may be captured in several versions, so its id alone doesn't name a capture.
    known = f"{page_id if page_id is not None else target} {digest}"
    main = record_id("capture", known)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{_END}"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", main),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest),
        ("WARC-Page-ID", _line(str(page_id))),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", _REVISIT_PROFILE),
            ("WARC-Refers-To", record_id("capture", f"{refers_to} {digest}")),
            ("WARC-Refers-To-Page-ID", _line(str(refers_to))),
            ("WARC-Payload-Length", str(size)),
        ]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    host = re.sub(r"^[a-z]+://|[/?#].*$", "", target)
    path = re.sub(r"^[a-z]+://[^/?#]*", "", target) or "/"
    request = f"GET {path} HTTP/1.1\r\nHost: {host}{_END}"

    def beside(kind: str, content: str, block: str) -> str:
        own = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(kind, known)),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", main),
            ("Content-Type", content),
        ]
        return _record(own, block)

    return [
        _record(headers, head + (payload if refers_to is None else "")),
        beside("request", "application/http; msgtype=request", request),
        beside("metadata", "application/warc-fields", f"charset: utf-8\r\nlength: {size}"),
    ]


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads the one with the largest page id is
    the response and the others refer to it; payloads below ``least_bytes`` are all responses.

    Null html counts as empty. Rows of one page id and one payload are one capture, as are rows
    with a null id and equal url and payload. Payloads are compared by SHA-256 and length; only
    those keys are grouped, so a payload that a third of all pages share is combined first.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    last = (
        keyed.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("key")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .where("first < last")
        .select(own_exchange("key").alias("same"), "last")
    )
    named = keyed.withColumn("same", own_exchange("key")).join(last.hint("shuffle_hash"), "same", "left")
    return named.select(
        "page_id", "url", "payload", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 64 << 20
) -> None:
    """Write one capture for each row of ``pages`` (``page_id, url, html``) to archives below
    ``path``, which every executor can reach. Spark's text writer ends each record with the two
    line breaks of the format and gzips an archive. A task begins another archive once one holds
    ``archive_bytes`` before compression, so an archive is longer by one capture at most."""
    captures = with_revisits(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                values, places = [], []
                for row in zip(*(column.to_pylist() for column in batch.slice(at, 256).columns)):
                    values.append(_END.join(capture_records(*row)))
                    places.append(archive)
                    held += len(values[-1])
                    if held >= archive_bytes:
                        archive, held = archive + 1, 0
                columns = [pa.array(values, pa.string()), pa.array(places, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["value", "archive"])

    records = captures.mapInArrow(run, "value string, archive int")
    writer = records.write.partitionBy("archive").option("lineSep", _END)
    writer.option("compression", "gzip").text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, some at a time: gzipped as a whole, record by record, or not."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(data, step)
            data = member.unused_data if member.eof else member.unconsumed_tail
            if not part and not member.eof and not data:
                raise ValueError("cut gzip archive")
            yield part
    for at in range(0, len(data), step):
        yield data[at : at + step]


_HEADER = re.compile(r"([^:\r\n]+):[ \t]*([^\r\n]*)")


class _Bytes:
    """What is left of a stream of bytes, read on demand."""

    def __init__(self, parts: Iterator[bytes]):
        self._parts, self._held, self.place = parts, bytearray(), 0

    def _more(self) -> bool:
        part = next(self._parts, None)
        if part is not None:
            self._held += part
        return part is not None

    def ended(self) -> bool:
        while not self._held:
            if not self._more():
                return True
        return False

    def take(self, size: int) -> bytes:
        """The next bytes, fewer at the end."""
        while len(self._held) < size and self._more():
            pass
        out = bytes(self._held[:size])
        del self._held[:size]
        self.place += len(out)
        return out

    def take_until(self, mark: bytes) -> bytes | None:
        """The bytes before the next ``mark``, which is passed; None if there is none."""
        looked = 0
        while (end := self._held.find(mark, looked)) < 0:
            looked = max(0, len(self._held) - len(mark) + 1)
            if not self._more():
                return None
        out = self.take(end)
        self.take(len(mark))
        return out


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, whose bytes come in
    parts; one record is held at a time."""
    archive = _Bytes(iter(parts))
    while not archive.ended():
        place = archive.place
        head = archive.take_until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        headers = {name.lower(): value for name, value in _HEADER.findall(head.decode("utf-8"))}
        size = int(headers["content-length"])
        block = archive.take(size)
        if len(block) != size or archive.take(4) != b"\r\n\r\n":
            raise ValueError(f"cut record {headers.get('warc-record-id')}")
        yield headers, block


_RECORD = (
    "record_id string, concurrent_to string, kind string, url string, page_id string, "
    "refers_to_page string, payload_bytes bigint, payload_digest string, block binary"
)


def read_records(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``. The digest and the number of payload bytes
    are computed from the payload read (a revisit has none and keeps what its headers say).

    An archive is held compressed, and one record of it at a time; rows leave in batches of at most
    1,024 records or 16 MB and one record. Empty archives give no rows; a cut one is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for headers, block in parse_records(inflated(content)):
                    kind, size, digest = headers["warc-type"], None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), payload_digest(payload)
                        if headers["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"digest of {headers['warc-record-id']} differs")
                    elif kind == "revisit":
                        size = int(headers["warc-payload-length"])
                        digest = headers["warc-payload-digest"].partition(":")[2]
                    rows.append(
                        (
                            headers["warc-record-id"],
                            headers.get("warc-concurrent-to"),
                            kind,
                            headers.get("warc-target-uri"),
                            headers.get("warc-page-id"),
                            headers.get("warc-refers-to-page-id"),
                            size,
                            digest,
                            block if with_blocks else None,
                        )
                    )
                    held += len(block) if with_blocks else 0
                    if len(rows) >= 1024 or held >= 1 << 24:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, _RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[part.split()[0] for part in _RECORD.split(", ")])
    return frame.astype({"payload_bytes": "Int64"})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the ``request`` and ``metadata``
    records that are concurrent to it (null where an archive lacks them).

    Copies of a record, as retries of a crawl leave them, count once; of different records with one
    id, which the format forbids, the least stays. Records of other kinds, and requests or metadata
    whose capture is missing, give no row. Long blocks are taken whole; no records give no rows.
    """
    is_main = F.col("kind").isin("response", "revisit")
    beside = F.col("kind").isin("request", "metadata")
    # The three kinds meet on one key in one shuffle, and the records are read once.
    capture = F.when(is_main, F.col("record_id")).when(beside, F.col("concurrent_to"))
    row = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "record_id")])

    def part(kind: str) -> Column:
        record = F.struct("record_id", "block")
        return F.min(F.when(F.col("kind") == kind, record)).alias(kind)

    joined = (
        records.withColumn("capture", capture)
        .where("capture is not null")
        .groupBy(F.col("capture").alias("record_id"))
        .agg(F.min(F.when(is_main, row)).alias("main"), part("request"), part("metadata"))
    )
    return joined.where("main is not null").select("record_id", "main.*", "request", "metadata")


def captured(column: str, kind: str = "long") -> Column:
    """A page id of an archive as a number; "None" stands for a missing one."""
    return F.expr(f"try_cast({column} AS {kind})")
