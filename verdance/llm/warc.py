"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a skippable frame at the
head of each archive; every record is a frame of its own, so one can be read by its offset. A record's
block is an HTTP response; one whose payload another record archives is written as a revisit of it,
without the payload. Where records are too few or too much alike for Zstandard's dictionary builder,
the sample itself is the dictionary.

Defined cases: a null html counts as empty; equal payloads are archived once, under the largest
page_id that has them; rows that repeat that page_id and payload are responses too; a null page_id is
the smallest, and where all page_ids of a payload are null, all its rows are responses; a record that
doesn't have its digest raises an error."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, hot_join, short_batches, stored

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: The dictionary's size, and the sample it is built from: so many records or parts of long ones, of so many bytes at most.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 64 << 10, 1500, 16 << 10
#: An archive ends with the record that brings it to so many bytes.
ARCHIVE = 4 << 20
#: Bytes of an archive that are decompressed at once.
PIECE = 4 << 10
LEVEL = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to, a revisit, whose block has no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; a revisit's payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it says")
    return fields, rest[rest.index(b"\r\n\r\n") + 4 : n]


def dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from SAMPLE records; a payload of more than SAMPLE_BYTES counts as several, each with a part of it."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    parts = pages.select("page_id", "url", html.alias("b"), F.explode(F.sequence(F.lit(0), F.greatest(F.length(html) - 1, F.lit(0)).cast("int"), F.lit(SAMPLE_BYTES))).alias("at"))
    parts = parts.select("page_id", "url", "at", F.substring("b", F.col("at") + 1, F.lit(SAMPLE_BYTES)).alias("part"))
    rows = bounded_sample(parts, ["page_id", "url", "at", "part"], SAMPLE).collect()
    made = sorted(record(r["page_id"], r["url"], bytes(r["part"]), digest(bytes(r["part"])), None) for r in rows)
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, made)) // 8), made).as_bytes()
    except (zstandard.ZstdError, ValueError):  # what the builder says of samples that are too few or too much alike
        return b"".join(made)[-DICTIONARY:]


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of every row of pages."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha1("payload")))
    newest = rows.groupBy("key").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = hot_join(rows, newest, ["key"], "n", "left")
    return rows.select("page_id", "url", "payload", F.when(~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, words: bytes) -> DataFrame:
    """Writes the archives, and returns them as rows (records, content); each content is a whole archive.

    A task holds one archive at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words)).compress
        leading = zstandard.ZstdCompressor(level=LEVEL).compress(words)
        head = struct.pack("<II", DICTIONARY_FRAME, len(leading)) + leading
        parts, size = [head], len(head)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([len(parts) - 1], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["records", "content"])
        for b in batches:
            ids, urls, refers = (b.column(k).to_pylist() for k in (0, 1, 3))
            for page_id, url, payload, to in zip(ids, urls, b.column(2), refers):
                payload = payload.as_py()
                frame = pack(record(page_id, url, payload, digest(payload), to))
                parts.append(frame)
                size += len(frame)
                if size >= ARCHIVE:
                    yield made()
                    parts, size = [head], len(head)
        if len(parts) > 1:
            yield made()

    short_batches(pages.sparkSession)
    return stored(marked(pages).mapInArrow(build, "records long, content binary"), "warc")


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself."""
    magic, n = struct.unpack("<II", archive[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with its dictionary")
    view, at = memoryview(archive), 8 + n
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(view[8:at]))
    unpack = zstandard.ZstdDecompressor(dict_data=words).decompressobj
    while at < len(view):
        d, parts = unpack(), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + PIECE]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every archived record.

    A response's length and digest are those of the payload read; a revisit's are those of the
    response that it refers to, whose digest must be the revisit's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x == "<urn:page:none>" else int(x[10:-1])
        for b in batches:
            for content in b.column(0):
                out = []
                for data in frames(content.as_py()):
                    fields, block = parsed(data)
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(block) != said:
                        raise ValueError("a payload doesn't have its digest")
                    out.append((number(fields["WARC-Record-ID"]), None if revisit else len(block), said, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = stored(archives.select("content").mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-index")
    responses = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    wanted = revisits.groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    there = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    found = hot_join(revisits, wanted.join(there, ["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "n", "left")
    found = found.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("long")))
    return responses.unionByName(found.select(responses.columns))


def archive(pages: DataFrame) -> DataFrame:
    """Archives every row of pages and reads the archives back: see read()."""
    return read(write(pages, dictionary(pages)))
