"""Byte-pair encoding and decoding with a public byte-level vocabulary.

encode(): merges by a priority queue of merge ranks over a doubly linked list of symbols; entries
that a later merge made stale are skipped when they come up. decode(): concatenates the
vocabulary's strings. Texts that name the special token in full get its id, as the vocabulary's
own library does.

Defined cases: a null text is the empty text, which has no ids; equal texts get equal ids; bytes
that do not form UTF-8 decode to the replacement character."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, unused, worker_tables

#: Entries of each of the two generations of the worker's memo of encoded words; results don't depend on it.
MEMO = 60_000
#: Longer runs without a break are encoded each time they come.
MEMO_CHARS = 40


def packed(path: str) -> bytes:
    """The vocabulary file at `path` (the library's JSON format), compressed for a broadcast."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def vocabulary(data: bytes) -> dict:
    """Ids, merges and special tokens of a packed vocabulary file."""
    spec = json.loads(zlib.decompress(data))
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"ids": model["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it
    prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


def _class_of(kinds: str, last: int) -> str:
    """A character class of the code points up to `last` whose Unicode category starts with a letter of kinds."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def word_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Splits text before merging: contractions, letters, numbers and other runs, each with one space before it, and white space.

    For texts whose code points are `last` at most: the shorter the classes are, the faster they are."""
    letters, numbers = _class_of("L", last), _class_of("N", last)
    space = "\\t-\\r \\x85\\xa0" + ("" if last < 256 else "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dict, the memo from a word to its ids as bytes."""

    def __init__(self, vocab: dict):
        super().__init__()
        self.older: dict[str, bytes] = {}
        ids = vocab["ids"]
        letters = byte_letters()
        byte_of = {x: b for b, x in enumerate(letters)}
        self.first = [ids[x] for x in letters]
        # By pair of ids, the merge's rank; by rank, the id that it makes.
        self.rank_of = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(vocab["merges"])}
        self.made = [ids[a + b] for a, b in vocab["merges"]]
        self.special = vocab["special"]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.strings = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, k in ids.items():
            self.strings[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, k in self.special.items():
            self.strings[k] = token.encode()
        self.find_latin, self.find_any = word_pattern(255).findall, word_pattern().findall

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.merged(word.encode())).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word's bytes. ranks[i] is the rank of symbol i with the one after it; a queue entry that says
        another one is stale."""
        symbols = [self.first[b] for b in word]
        n = len(symbols)
        rank_of, made, none = self.rank_of.get, self.made, len(self.made)
        ranks = [rank_of(pair, none) for pair in zip(symbols, symbols[1:])]
        queue = [r * n + i for i, r in enumerate(ranks) if r < none]
        if not queue:
            return symbols
        ranks.append(none)
        heapify(queue)
        following, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            r, i = divmod(heappop(queue), n)
            if ranks[i] != r:
                continue  # stale
            j = following[i]
            k = following[i] = following[j]
            s = symbols[i] = made[r]
            symbols[j], ranks[j] = -1, none
            if k < n:
                before[k] = i
                ranks[i] = r = rank_of((s, symbols[k]), none)
                if r < none:
                    heappush(queue, r * n + i)
            else:
                ranks[i] = none
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank_of((symbols[h], s), none)
                if r < none:
                    heappush(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def _words(self, text: str) -> list[str]:
        return self.find_latin(text) if text.isascii() or _latin(text) else self.find_any(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split is None or not self.split.search(text):
            return b"".join(map(self.__getitem__, self._words(text)))
        out, at = [], 0
        for m in self.split.finditer(text):
            out += map(self.__getitem__, self._words(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.__getitem__, self._words(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def coder(spark: SparkSession, path: str, digest: bool = False):
    """A Column function from a text to its ids (bytes) and their decoded text, or to the digests of both.

    The packed vocabulary, of fixed size, is broadcast; each Python worker builds its tables once."""
    short_batches(spark)
    sent, name = spark.sparkContext.broadcast(packed(path)), path

    @F.arrow_udf(DIGEST if digest else RESULT)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = worker_tables(f"bpe {name}", lambda: Codec(vocabulary(sent.value)))
        for batch in batches:
            ids, texts, hashes, sizes = [], [], [], []
            for x in batch:
                b = codec.encode(x.as_py() or "")
                t = codec.decode(b)
                if digest:
                    sizes.append(len(b) // 4)
                    hashes.append(hashlib.sha256(b).hexdigest())
                    texts.append(hashlib.sha256(t.encode()).hexdigest())
                else:
                    ids.append(b)
                    texts.append(t)
            if digest:
                yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=DIGEST.names)
            else:
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=RESULT.names)

    return code


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with bpe_ids (binary: little-endian unsigned 32-bit ids), bpe_n_tokens and bpe_decoded; columns of those names are replaced."""
    name = unused(docs, "bpe")
    coded = docs.withColumn(name, coder(docs.sparkSession, path)(F.col(text)))
    made = {"bpe_ids": F.col(f"{name}.ids"), "bpe_n_tokens": (F.length(f"{name}.ids") / 4).cast("long"), "bpe_decoded": F.col(f"{name}.decoded")}
    return coded.withColumns(made).drop(name)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text of docs, one row per row."""
    code = coder(docs.sparkSession, path, digest=True)
    return docs.select("doc_id", code("text").alias("x")).select("doc_id", "x.*")
