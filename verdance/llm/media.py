"""Media columns: payloads as 8-bit samples, stored in content-defined chunks.

A payload is stored as a WAV file of 8-bit mono samples. Its samples are cut where a rolling gear hash of
the last 32 bytes has enough zero bits, between LEAST and MOST bytes; chunks are named by their
SHA-256. The header, which tells the length, stays in the file's record, so payloads that begin alike
share their first chunks. An aggregation by digest finds the digests that come more than once. Chunks of those go to
a common store that keeps each digest once. Chunks that no other place has stay, by choice, in their file's own
record, so most bytes are never shuffled. A file's record lists its chunks in order, common ones by digest only.
Reading joins those digests with the store, puts the chunks in order and verifies the file's digest.

Which chunks are common is known to the tasks by a Bloom filter that is sized by their number, up to
MOST_WORDS words; a chunk that passes it by chance just goes to the store as well.

Defined cases: a null text counts as empty; an empty text's payload is one block of zero bytes;
equal texts have equal files and share every chunk; repeated rows are one file each; a chunk or a
file that is missing or doesn't have its digest raises an error."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, short_batches, stored, text_md5, utf8_view

BLOCK = 64
#: Samples a second, as the header says.
RATE = 8000
#: Digests that share a word of 64 bits of the Bloom filter of common ones on average, and its words at most: 16 MB.
KEYS_EACH, MOST_WORDS = 4, 1 << 21
#: Chunk sizes in bytes: least, on average beyond it, most.
LEAST, AVERAGE, MOST = 1 << 10, 1 << 12, 1 << 15
#: The gear hash holds the last 32 bytes; a cut needs its upper bits, on which most of them tell, to be zero.
_GEAR = np.random.default_rng(16).integers(0, 1 << 32, 256, dtype=np.uint32)
_ZERO_BITS = np.uint32((AVERAGE - 1) << 20)


def header(n: int) -> bytes:
    """The header of a WAV file of n 8-bit mono samples; n is a multiple of BLOCK, so even."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def samples(file: bytes) -> bytes:
    """The samples of a WAV file with such a header."""
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or file[36:40] != b"data":
        raise ValueError("not a WAV file of 8-bit mono samples")
    return file[44 : 44 + struct.unpack("<I", file[40:44])[0]]


def padded(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the rolling hash of it and the 31 bytes before: h = 2h + gear, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(payload: bytes) -> list[int]:
    """The ends of the payload's chunks."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    ready = np.flatnonzero((gear(np.frombuffer(payload, np.uint8)) & _ZERO_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(ready, at + LEAST))
        end = min(int(ready[k]) if k < len(ready) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _files(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """Raw text, header and chunks of each text of a batch (media, text, ...)."""
    data, offsets = utf8_view(batch.column(1))
    for r in range(batch.num_rows):
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        payload = padded(raw)
        ends = cuts(payload)
        yield raw, header(len(payload)), [payload[a:b] for a, b in zip([0, *ends], ends)]


def _word(digest: bytes, words: int) -> int:
    return int.from_bytes(digest[:4], "big") % words


def _mask(digest: bytes) -> int:
    return 1 << (digest[4] & 63) | 1 << (digest[5] & 63) | 1 << (digest[6] & 63) | 1 << (digest[7] & 63)


def common_digests(keyed: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests that come more than once in all files, as words of 64 bits."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).digest() for _, _, parts in _files(b) for c in parts], pa.binary())], names=["digest"])

    often = stored(keyed.mapInArrow(named, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "media-often")
    words = min(MOST_WORDS, max(1, -(-often.count() // KEYS_EACH)))
    number = lambda at, size: F.conv(F.hex(F.substring("digest", at, size)), 16, 10).cast("long")
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for at in (5, 6, 7, 8):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, (number(at, 1) % 64).cast("int")))
    filled = often.select((number(1, 4) % words).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    discard(often)
    out = np.zeros(words, np.uint64)
    out[filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return out


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the files of docs and returns (records, common chunks).

    records: doc_id, media (the text's MD5), n_bytes, file_sha256, header and parts (digest, and bytes or
    null if the chunk is common), one row per row of docs. Common chunks: digest, bytes and n, in
    how many places they are. Bytes are zstd frames. The store's aggregation combines before the shuffle, so a
    chunk that millions of files hold travels once a task."""
    short_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(text_md5(text).alias("media"), text.alias("text"), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(common_digests(keyed))

    def is_common(digest: bytes) -> bool:
        m = _mask(digest)
        return int(sent.value[_word(digest, len(sent.value))]) & m == m

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            n_bytes, shas, heads, lists = [], [], [], []
            for raw, head, parts in _files(b):
                n_bytes.append(len(raw))
                heads.append(head)
                whole = hashlib.sha256(head)
                named = []
                for c in parts:
                    whole.update(c)
                    d = hashlib.sha256(c).digest()
                    named.append({"digest": d, "bytes": None if is_common(d) else pack(c)})
                shas.append(whole.digest())
                lists.append(named)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(n_bytes, pa.int64()), pa.array(shas, pa.binary()), pa.array(heads, pa.binary()), pa.array(lists, PARTS)], names=["doc_id", "media", "n_bytes", "file_sha256", "header", "parts"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            count: dict[bytes, int] = {}
            held: dict[bytes, bytes] = {}
            for _, _, parts in _files(b):
                for c in parts:
                    d = hashlib.sha256(c).digest()
                    if is_common(d):
                        count[d] = count.get(d, 0) + 1
                        if d not in held:
                            held[d] = pack(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["digest", "bytes", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    files = stored(keyed.mapInArrow(records, f"doc_id {kind}, media binary, n_bytes long, file_sha256 binary, header binary, parts array<struct<digest:binary,bytes:binary>>"), "media-records")
    chunks = keyed.mapInArrow(shared, "digest binary, bytes binary, n long").groupBy("digest").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n"))
    return files, stored(chunks, "media-chunks")


PARTS = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
MEASURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: The columns that measure() returns after the key.
NAMES = [f.split()[0] for f in MEASURES.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def measure(files: DataFrame, key: str) -> DataFrame:
    """What MEASURES says of each file, from its header and chunks as read back: columns (key, n_bytes, file_sha256, header, parts).

    feature: mean and standard deviation of the samples and the share of neighbours that lie on
    either side of 128, to six places, and the number of chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for n_bytes, sha, head, parts in zip(*(b.column(k) for k in (1, 2, 3, 4))):
                sha, parts = sha.as_py(), parts.as_py()
                if any(p["bytes"] is None for p in parts):
                    raise ValueError("a chunk is missing from the store")
                plain = [unpack(p["bytes"]) for p in parts]
                file = b"".join([head.as_py(), *plain])
                if any(hashlib.sha256(x).digest() != p["digest"] for x, p in zip(plain, parts)) or hashlib.sha256(file).digest() != sha:
                    raise ValueError("a stored file doesn't have its digest")
                payload = samples(file)
                x = np.frombuffer(payload, np.uint8)
                high = x >= 128
                crossing = float(np.count_nonzero(high[1:] != high[:-1])) / (len(x) - 1)
                out.append((n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), sha.hex(), f"{float(x.mean()):.6f},{float(x.std()):.6f},{crossing:.6f},{len(parts)}"))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(TYPES), TYPES))], names=[key, *NAMES])

    return files.select(key, "n_bytes", "file_sha256", "header", "parts").mapInArrow(read, f"{key} {files.schema[key].dataType.simpleString()}, {MEASURES}")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and what MEASURES says, of every row of docs, by way of the store.

    Files without common chunks are read where they lie. Of the others each distinct one is put
    together once, and all rows with its text find its values by the text's MD5."""
    files, chunks = store(docs)
    partial = F.exists("parts", lambda p: p["bytes"].isNull())
    whole = measure(files.where(~partial), "doc_id")
    open_ = files.where(partial)
    each = open_.groupBy("media").agg(F.first(F.struct("n_bytes", "file_sha256", "header", "parts")).alias("f"), F.count(F.lit(1)).alias("n"))
    each = stored(each.select("media", "n", "f.*"), "media-open")
    wanted = each.select("media", F.posexplode("parts").alias("pos", "p")).where("p.bytes IS NULL").select("media", "pos", "p.digest")
    found = hot_join(wanted, chunks, ["digest"], "n").groupBy("media").agg(F.map_from_entries(F.collect_list(F.struct("pos", "bytes"))).alias("found"))
    filled = F.transform("parts", lambda p, i: F.struct(p["digest"].alias("digest"), F.coalesce(p["bytes"], F.element_at("found", i)).alias("bytes")))
    joined = each.join(found, "media").select("media", "n", "n_bytes", "file_sha256", "header", filled.alias("parts"))
    measured = stored(measure(joined, "media"), "media-measures").join(each.select("media", "n"), "media")
    rest = hot_join(open_.select("doc_id", "media"), measured, ["media"], "n").select("doc_id", *NAMES)
    return whole.unionByName(rest)
