"""Benchmark decontamination: MinHash containment search by size classes, verified exactly.

A test item is the set of its five-word shingles; a document contains it if it has at least
CONTAINED of them. Items are put in classes by size, each between 2**k and 2**(k+1) shingles. For
each class a document is cut in overlapping segments of about four times the least size, so that an
item and the segment that holds it are of like size, however long the document: their MinHash
signatures then share a slot with near certainty. A shared slot makes a candidate, and the shingles of
the whole document decide, compared as words.

The items go to the tasks in blocks of BLOCK_SHINGLES shingles, one block at a time: a bounded
broadcast (an item longer than a block stands alone). A longer benchmark means more passes over the
documents, none of which shuffles them; a pass is written and its block released before the next.

An item of one to four words has no five-word shingle. It is one run of all its words, and a document contains it
that has this run anywhere; a block's runs of each such length are looked up among the document's runs of that length.

Defined cases: a null text or one without words contains nothing and is contained nowhere; repeated items
count once, repeated documents each; an empty benchmark finds nothing; item ids may be of any type."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textnum
from .common import discard, pieces, short_batches, stored, unused, utf8_view, worker_tables

CONTAINED = 0.8
#: Slots of a signature. A segment that holds 0.8 of an item shares a given slot with chance 0.16 at
#: least, so a contained item is missed with chance 0.84 ** 96, about 5e-8.
SLOTS = 96
BLOCK_SHINGLES = 2_000_000
_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(textnum.WORD_PATTERN)


def word_runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    """The distinct runs of n words."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def item_shingles(text: str) -> set[tuple[str, ...]]:
    """The distinct five-word shingles of an item in lower case, or one run of its words if they are fewer."""
    w = _WORD.findall(text)
    return word_runs(w, min(len(w), textnum.SHINGLE)) if w else set()


def _slot_values(hashes: np.ndarray, k: int) -> np.ndarray:
    return (hashes * _MULTIPLY[k]) >> np.uint64(32)


class Items:
    """A block of items, ready for the search: by size class, the slots' minima in sorted order with their items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.shingles = [item_shingles(r[1]) for r in rows]
        #: Of items under five words: by number of words, the sorted hashes of their runs and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        data = "\n".join(r[1] for r in rows).encode()
        sizes = [len(r[1].encode()) + 1 for r in rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        offsets[-1] -= 1
        hashes, _, at = textnum.words(np.frombuffer(data, np.uint8), offsets)
        sh, so = textnum.shingles(hashes, at)
        found: dict[int, list[list[tuple[int, int]]]] = {}
        n_words = np.diff(at)
        for n in sorted({int(x) for x in n_words if 0 < x < textnum.SHINGLE}):
            items = np.flatnonzero(n_words == n)
            values = sh[so[items]]
            order = np.argsort(values, kind="stable")
            self.short[n] = values[order], items[order]
        for i in np.flatnonzero(n_words >= textnum.SHINGLE).tolist():
            own = np.unique(sh[so[i] : so[i + 1]])
            if len(own):
                slots = found.setdefault(len(own).bit_length() - 1, [[] for _ in range(SLOTS)])
                for k in range(SLOTS):
                    slots[k].append((int(_slot_values(own, k).min()), i))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c, slots in found.items():
            self.classes[c] = [(np.array([v for v, _ in sorted(s)], np.uint64), np.array([i for _, i in sorted(s)])) for s in slots]

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a slot in some segment, or a run of a short item, for texts with word hashes at offsets at."""
        out: set[tuple[int, int]] = set()
        for n, (values, items) in self.short.items():
            runs, offsets = textnum.runs_of(hashes, at, n)
            left, right = (np.searchsorted(values, runs, side) for side in ("left", "right"))
            for h in np.flatnonzero(left < right):
                owner = int(np.searchsorted(offsets, h, "right")) - 1
                out.update((owner, int(i)) for i in items[left[h] : right[h]])
        sh, so = textnum.shingles(hashes, at)
        n = np.diff(so)
        if not len(sh) or not self.classes:
            return out
        least = min(self.classes, default=0)
        # Blocks of the least class's stride; longer strides join neighbours of the same text.
        stride = 2 << least
        blocks = -(-n // stride)
        of = np.repeat(np.arange(len(n)), blocks)
        starts = so[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * stride
        for k in range(SLOTS):
            minima, owner = np.minimum.reduceat(_slot_values(sh, k), starts), of
            for c in range(least, max(self.classes) + 1):
                if c > least:
                    first = np.concatenate([[True], owner[1:] != owner[:-1]])
                    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
                    lead = np.flatnonzero(rank % 2 == 0)
                    minima, owner = np.minimum.reduceat(minima, lead), owner[lead]
                if c not in self.classes:
                    continue
                values, items = self.classes[c][k]
                segment = minima.copy()
                same = owner[1:] == owner[:-1]
                segment[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                left = np.searchsorted(values, segment, "left")
                hit = np.flatnonzero((left < len(values)) & (values[np.minimum(left, len(values) - 1)] == segment))
                for h in hit:
                    v = segment[h]
                    j = int(left[h])
                    while j < len(values) and values[j] == v:
                        out.add((int(owner[h]), int(items[j])))
                        j += 1
        return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """The distinct items (id, text in lower case), BLOCK_SHINGLES words or so at a time, and whether they are the last ones."""
    items = benchmark.select("item_id", F.lower("text").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("text") + 1)).collect()[0][0] or 0
    n = -(-int(size) // (BLOCK_SHINGLES * 6))
    for k in range(n):
        yield sorted(((r[0], r[1]) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()), key=repr), k == n - 1


def result_type(item_id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item_id", item_id), T.StructField("n_shingles", T.IntegerType()), T.StructField("n_shared", T.IntegerType()), T.StructField("containment", T.DoubleType())])


def hits(sent: Broadcast, item_id: T.DataType, contained: float = CONTAINED) -> Column:
    """For each text, an array of item_id, n_shingles, n_shared and containment of the items of a block that it contains."""
    kind = T.ArrayType(result_type(item_id))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_tables("decontamination")
        items = Items(sent.value)
        for texts in batches:
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            data, offsets = utf8_view(texts)
            for i, j in pieces(offsets, 1 << 18):
                hashes, _, at = textnum.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                last, words, whole = -1, [], {}
                for t, k in sorted(items.candidates(hashes, at)):
                    if t != last:
                        last, words, whole = t, _WORD.findall(texts[i + t].as_py()), {}
                    own = items.shingles[k]
                    n = len(next(iter(own)))
                    if n not in whole:
                        whole[n] = word_runs(words, n)
                    shared = len(own & whole[n])
                    if shared >= contained * len(own):
                        found[i + t].append({"item_id": items.ids[k], "n_shingles": len(own), "n_shared": shared, "containment": shared / len(own)})
            yield pa.array(found, arrow)

    return search(F.lower(F.coalesce("text", F.lit(""))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment: one row for each item that a row of docs contains."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = benchmark.schema["item_id"].dataType
    out = spark.createDataFrame([], result_type(kind)).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "*")
    for rows, last in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(rows)
        found = docs.select("doc_id", F.explode(hits(sent, kind)).alias("x")).select("doc_id", "x.*")
        if last:
            return out.unionByName(found)
        out = out.unionByName(stored(found, "contaminated"))
        sent.destroy()
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain an item; all columns stay, and nothing is shuffled."""
    spark, name = docs.sparkSession, unused(docs, "hits")
    short_batches(spark)
    left = docs
    for rows, last in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(rows)
        clean = left.withColumn(name, hits(sent, benchmark.schema["item_id"].dataType)).where(F.size(name) == 0).drop(name)
        if last:
            return clean
        before, left = left, stored(clean, "clean")
        sent.destroy()
        if before is not docs:
            discard(before)
    return left
