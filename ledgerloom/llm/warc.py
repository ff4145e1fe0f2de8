"""WARC archives of pages: written as chunks, read back as streams.

The unit everywhere is a chunk: a record's identifier, a chunk number and at most ``CHUNK_BYTES`` of payload. A payload
that fits is one ``response`` record; a longer one is a segmented record (WARC-Segment-Number), its first chunk the
response and each other chunk a ``continuation``. A page whose payload another page already holds is a ``revisit``
without payload.

Archives are gzipped text files: a chunk is one row, whose record ends in CRLF CRLF, the last line feed of which is the
line separator that Spark's text writer adds, and a file is one gzip member. A gzipped file is read by one task from front to back, line by line, so the
reader is a state machine over lines: it gives a payload as rows of chunks, each with the size and the SHA-1 of all up to
it, and never holds a record. All chunks of a record lie in one file, one behind another, as one task writes them; in archives
made elsewhere a record whose segments are apart is reported as such.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import cut, scratch_path

#: The most payload bytes of one chunk.
CHUNK_BYTES = 1 << 20
#: Bytes of record text that a task hands over at once.
BATCH_BYTES = 4 << 20

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = b"WARC-Date: 1970-01-01T00:00:00Z"


def _record(kind: bytes, record_id: bytes, fields: list[bytes], block: list) -> bytes:
    size = sum(len(x) for x in block)
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + record_id + b">", _DATE, *fields]
    return b"".join([b"\r\n".join([*head, b"Content-Length: %d" % size, b"", b""]), *block, b"\r\n\r"])


def _chunk_ends(payload: memoryview, most: int) -> list[int]:
    """Ends of the chunks of a payload, moved back to the begin of a character."""
    ends, at = [], 0
    while len(payload) - at > most:
        end = at + most
        for back in range(4):
            if payload[end - back] & 0xC0 != 0x80:
                end -= back
                break
        ends.append(end)
        at = end
    return [*ends, len(payload)]


def _records(most: int):
    """The record text of every chunk, of at most ``most`` payload bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for rows in batches:
            payloads = rows.column("payload")
            names = [rows.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "first", "digest")]
            for i, (page, url, refers_to, first, digest) in enumerate(zip(*names)):
                page = b"%d" % page if page is not None else b""
                uri = (url or "").encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
                payload = memoryview(payloads[i].as_buffer() or b"") if payloads[i].is_valid else memoryview(b"")
                ends = _chunk_ends(payload, most)
                fields = [
                    b"WARC-Target-URI: " + uri,
                    b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
                    b"Content-Type: application/http; msgtype=response",
                ]
                if not first:
                    about = [
                        b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                        b"WARC-Payload-Length: %d" % len(payload),
                    ]
                    out.append(_record(b"revisit", b"urn:page:" + page, fields + about, [_HTTP]))
                    held += len(out[-1])
                    continue
                at = 0
                for number, end in enumerate(ends, 1):
                    name, own, block = b"urn:page:" + page, list(fields), [payload[at:end]]
                    if number > 1:
                        name, own = b"%s:%d" % (name, number), [b"WARC-Segment-Origin-ID: <urn:page:" + page + b">"]
                    else:
                        block.insert(0, _HTTP)
                    if len(ends) > 1:
                        own.append(b"WARC-Segment-Number: %d" % number)
                        if number == len(ends):
                            own.append(b"WARC-Segment-Total-Length: %d" % (len(payload) + len(_HTTP)))
                    out.append(_record(b"continuation" if number > 1 else b"response", name, own, block))
                    held, at = held + len(out[-1]), end
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_warc(
    pages: DataFrame, path: str, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Write a record per row to gzipped WARC files in the folder ``path``, by way of Spark's own committer.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest page_id is the response, others
    are revisits that refer to it; shorter payloads are always responses. A NULL payload is empty, a NULL address is the
    empty one. Rows that share page_id and payload are judged alike. A row without page_id is a revisit of a row that has
    one, or else a response. Other columns are ignored.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    # Payloads that only one row holds are most. The others' table is written first, so that Spark knows its size: where
    # it is small, no payload moves.
    owners = cut(
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies"),
        "owners",
    )
    judged = rows.join(owners, ["digest", "size"], "left")
    first = F.coalesce(F.col("page_id") == F.col("refers_to"), F.col("refers_to").isNull())
    judged.select("page_id", "url", "payload", "refers_to", first.alias("first"), "digest").mapInArrow(
        _records(CHUNK_BYTES), "record binary"
    ).select(F.col("record").cast("string")).write.option("compression", "gzip").text(path)


_HEADS = {
    b"warc-type": "kind", b"warc-record-id": "record_id", b"content-length": "length", b"warc-refers-to": "refers_to",
    b"warc-segment-number": "segment", b"warc-segment-origin-id": "origin", b"warc-payload-digest": "stated",
    b"warc-payload-length": "stated_bytes", b"warc-segment-total-length": "total", b"warc-target-uri": "url",
}

_CHUNKS = (
    "record_id string, url string, kind string, refers_to string, chunk int, payload binary, bytes bigint, digest string,"
    " end boolean, whole boolean, stated string, stated_bytes bigint, error string"
)


class _Reader:
    """Lines of WARC files, without their line feeds, to rows of chunks.

    A run is what is read of one record: its first segment and those that follow it. Of a payload only the chunk being
    filled is held, and the one before it, until it is known whether the run ends with it.
    """

    def __init__(self, payloads: bool, most: int):
        self.payloads, self.most = payloads, most
        self.heads: dict[str, bytes] | None = None
        self.left = -1
        self.http = False
        self.run: dict | None = None
        self.piece = bytearray()
        self.size = 0
        self.held: dict | None = None
        self.gap = 0

    def line(self, line: memoryview) -> Iterator[dict]:
        if self.left >= 0:
            yield from self.content(line)
        elif self.gap:
            self.gap -= 1
        elif self.heads is None:
            text = bytes(line)
            if text.startswith(b"WARC/"):
                self.heads = {}
            elif text.strip():
                yield {"error": f"not a record: {text[:60]!r}"}
        elif len(line) <= 1:
            yield from self.begin()
        else:
            name, _, value = bytes(line).partition(b":")
            if known := _HEADS.get(name.strip().lower()):
                self.heads[known] = value.strip()

    def begin(self) -> Iterator[dict]:
        heads = self.heads
        kind, segment = heads.get("kind", b"").decode(), int(heads.get("segment", b"0"))
        name = (heads.get("origin") if kind == "continuation" else heads.get("record_id", b"")).decode().strip("<>")
        follows = self.run is not None and kind == "continuation" and self.run["next"] == (name, segment)
        if not follows:
            yield from self.close()
            text = lambda key: heads[key].decode("utf-8", "replace") if key in heads else None
            self.run = {
                "record_id": name, "url": text("url"), "kind": kind, "refers_to": (text("refers_to") or "").strip("<>") or None,
                "stated": text("stated"), "stated_bytes": int(heads["stated_bytes"]) if "stated_bytes" in heads else None,
                "begins": segment <= 1 and kind != "continuation", "last": segment == 0, "chunk": 0, "bytes": 0,
                "sha": hashlib.sha1(),
            }
        self.run["next"] = name, segment + 1
        self.run["last"] |= "total" in heads
        self.http = kind in ("response", "revisit")
        self.left = int(heads["length"])
        if self.left == 0:
            yield from self.end()

    def content(self, line: memoryview) -> Iterator[dict]:
        """One line of the block; the line feed behind it counts too unless the block ends before it."""
        own = line[: self.left]
        feed = self.left > len(line)
        self.left -= len(own) + feed
        if self.http:
            self.http = len(own) > 1
        else:
            at = 0
            while at < len(own):
                part = own[at : at + self.most - self.size]
                at += len(part)
                yield from self.taken(part)
            if feed:
                yield from self.taken(b"\n")
        if self.left == 0:
            yield from self.end(rest=not feed)

    def taken(self, part: memoryview | bytes) -> Iterator[dict]:
        """Payload bytes that the chunk being filled has room for; a full chunk is done when more come."""
        if self.size + len(part) > self.most or self.size == self.most:
            yield from self.chunk()
        self.run["sha"].update(part)
        self.size += len(part)
        if self.payloads:
            self.piece += part

    def chunk(self) -> Iterator[dict]:
        """The chunk filled so far is done; the one before it is known not to be the last."""
        if self.held is not None:
            yield self.held
        run = self.run
        run["chunk"] += 1
        run["bytes"] += self.size
        names = ("record_id", "url", "kind", "refers_to", "chunk", "bytes", "stated", "stated_bytes")
        self.held = {name: run[name] for name in names} | {
            "payload": bytes(self.piece) if self.payloads else None,
            "digest": base64.b32encode(run["sha"].digest()).decode(),
            "end": False,
        }
        self.piece, self.size = bytearray(), 0

    def end(self, rest: bool = False) -> Iterator[dict]:
        """After a block come two line ends; ``rest``: the first of them ended the block's last line."""
        self.left, self.heads, self.gap = -1, None, 1 if rest else 2
        if self.size or not self.run["chunk"]:
            yield from self.chunk()
        if self.run["last"]:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.run is not None:
            if self.size or not self.run["chunk"]:
                yield from self.chunk()
            yield self.held | {"end": True, "whole": self.run["begins"] and self.run["last"]}
            self.run = self.held = None


_CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()),
        ("chunk", pa.int32()), ("payload", pa.binary()), ("bytes", pa.int64()), ("digest", pa.string()),
        ("end", pa.bool_()), ("whole", pa.bool_()), ("stated", pa.string()), ("stated_bytes", pa.int64()),
        ("error", pa.string()),
    ]
)


def _parsed(payloads: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, held = _Reader(payloads, most), [], 0
        for rows in batches:
            column = rows.column("value").cast(pa.large_binary())
            data = column.buffers()[2]
            view = memoryview(data) if data is not None else memoryview(b"")
            offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
            for a, b in zip(offsets, offsets[1:]):
                for row in reader.line(view[a:b]):
                    out.append(row)
                    held += len(row.get("payload") or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_SCHEMA)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_SCHEMA)
                out, held = [], 0
        out += reader.close()
        yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_SCHEMA)

    return run


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunked record table of archives: a row for each record identifier and chunk number.

    Columns: record_id, url, kind, refers_to, chunk (from 1), payload (at most ``CHUNK_BYTES``, NULL without ``payloads``),
    bytes and digest of the record's payload up to and with this chunk, end (the record's last row), whole (on that row:
    whether the record was there from its first segment to its last), stated, stated_bytes, error. A chunk ends where a
    segment does; an empty payload is one empty chunk. What is no record is a row with ``error`` only.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parsed(payloads, CHUNK_BYTES), _CHUNKS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, url, kind, refers_to, bytes and digest of the payload as read, stated digest, error.

    These are the last chunk rows, as digests and sizes run on from chunk to chunk. Revisits carry the bytes and digest they
    state. ``error`` tells what is wrong with a record: a digest that differs from the stated one, or a missing segment.
    """
    runs = read_chunks(spark, path, payloads=False).where("end or error is not null")
    stated = F.regexp_replace("stated", "^sha1:", "")
    revisit = F.col("kind") == "revisit"
    wrong = F.when(~F.col("whole"), "segments apart").when(~revisit & (stated != F.col("digest")), "digest differs")
    return runs.select(
        "record_id", "url", "kind", "refers_to",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("digest"),
        stated.alias("stated"), F.coalesce("error", wrong).alias("error"),
    )


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to a new folder of archives in the shared folder, and that folder read."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, least)
    return read_warc(pages.sparkSession, path)
