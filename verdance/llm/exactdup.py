"""Exact dedup: a minimal perfect hash over the distinct digests of a history, looked up by later rows.

Texts are equal when they are identical after lower-casing A-Z only; a text's digest is the SHA-256 of
that form in UTF-8. Only digests, ids and row numbers are moved, never texts.

Index. The history's distinct digests are dealt to shards of KEYS_EACH or so by a hash of the digest. A shard's
minimal perfect hash is a cascade of bit arrays: at each level the digests left are hashed to as many
places as there are of them, one that has a place for itself stays there, and those that meet go on to the
next level, under another hash. A digest's slot is the rank of its bit, so n digests fill n slots. A slot
holds the full digest, the locator of the row that wins (its id and row number) and how many rows
have the digest. The hash sends a digest that the history doesn't have to some slot, too; therefore
a lookup compares all 32 bytes.

Lookup. Later rows are grouped by digest first, so that however many copies there are, one row goes
to the digest's shard. There members join the slot's group and nonmembers form groups of their own. The
group's winner is the greater of both; the answer goes back to the rows by hot_join, as a group may hold
most rows.

Defined cases: a null text counts as empty, and all empty texts are equal; the greatest doc_id of a
group stays, a null id only where no other is there; of rows alike in id one stays (that of the greatest
row number); an empty table or history has no group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import discard, hot_join, stored

#: Digests of a shard, on average; a shard is built and looked up in one task's memory.
KEYS_EACH = 4096
DIGEST = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def digest_of(text: Column) -> Column:
    """SHA-256 (binary) of a text with A-Z in lower case."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def _placed(words: np.ndarray, level: int, places: int) -> np.ndarray:
    """The place at a level of digests given as rows of four 64-bit words. All words count, so unequal digests part at some level."""
    factors = textnum.mix(np.arange(1, 5, dtype=np.uint64) + _U(level * 4)) | _U(1)
    mixed = textnum.mix((words * factors).sum(axis=1, dtype=np.uint64))
    return ((mixed >> _U(32)) * _U(places) >> _U(32)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> list[np.ndarray]:
    """The levels of a minimal perfect hash over unequal digests: boolean arrays with one True for each digest."""
    levels: list[np.ndarray] = []
    while len(words):
        at = _placed(words, len(levels), len(words))
        alone = np.bincount(at, minlength=len(words)) == 1
        levels.append(alone)
        words = words[~alone[at]]
    return levels


def slots(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each digest; for a digest that isn't in the hash some slot, or -1."""
    out = np.full(len(words), -1, np.int64)
    left, before = np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = _placed(words[left], k, len(bits))
        here = bits[at]
        out[left[here]] = before + (np.cumsum(bits) - 1)[at[here]]
        before += int(bits.sum())
        left = left[~here]
    return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """Binary values of 32 bytes as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, DIGEST // 8) if len(digests) else np.zeros((0, DIGEST // 8), "<u8")


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, won (the greatest doc_id and row) and n of rows (doc_id, row, digest)."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("won"), F.count(F.lit(1)).alias("n"))


class Index:
    """A minimal perfect hash over the digests of `groups` (digest, won, n), as a table with a row for each shard.

    levels: the bit arrays in turn, packed; sizes: their lengths; keys, won and counts: by slot."""

    def __init__(self, groups: DataFrame, n: int):
        self.shards = max(1, -(-n // KEYS_EACH))
        self.won = groups.schema["won"].dataType.simpleString()
        self.schema = f"shard int, sizes array<int>, levels binary, keys binary, won array<{self.won}>, counts array<long>"

        def build(key: tuple, table: pa.Table) -> pa.Table:
            words = _words(table["digest"])
            levels = perfect_hash(words)
            order = pa.array(np.argsort(slots(words, levels)))
            table = table.take(order)
            won = table["won"].combine_chunks()
            n = pa.array([0, len(won)], pa.int32())
            return pa.table({
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
                "levels": pa.array([b"".join(np.packbits(x).tobytes() for x in levels)], pa.binary()),
                "keys": pa.array([b"".join(table["digest"].to_pylist())], pa.binary()),
                "won": pa.ListArray.from_arrays(n, won),
                "counts": pa.ListArray.from_arrays(n, table["n"].combine_chunks()),
            })

        dealt = groups.withColumn("shard", _shard(F.col("digest"), self.shards))
        self.table = stored(dealt.groupBy("shard").applyInArrow(build, self.schema), "exact-index")

    def lookup(self, groups: DataFrame) -> DataFrame:
        """The groups (digest, won, n) of history and `groups` together; `member` says whether the history had the digest."""

        def find(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
            keys, levels = np.zeros((0, DIGEST // 8), "<u8"), []
            old, counts = asked["won"].combine_chunks().slice(0, 0), asked["n"].combine_chunks().slice(0, 0)
            if index.num_rows:
                packed, at = np.frombuffer(index["levels"][0].as_py(), np.uint8), 0
                for size in index["sizes"][0].as_py():
                    levels.append(np.unpackbits(packed[at : at + -(-size // 8)], count=size).astype(bool))
                    at += -(-size // 8)
                keys = np.frombuffer(index["keys"][0].as_py(), "<u8").reshape(-1, DIGEST // 8)
                old, counts = index["won"].combine_chunks().flatten(), index["counts"].combine_chunks().flatten()
            words = _words(asked["digest"])
            slot = slots(words, levels)
            member = slot >= 0
            member[member] = (keys[slot[member]] == words[member]).all(axis=1)
            unmet = np.ones(len(keys), bool)
            unmet[slot[member]] = False
            met = pa.array(np.where(member, slot, 0), mask=~member)
            rest = np.flatnonzero(unmet)
            both = pa.table({"digest": asked["digest"], "won": asked["won"], "n": asked["n"], "old": old.take(met), "old_n": counts.take(met), "member": pa.array(member)})
            others = pa.table({"digest": pa.array([keys[i].tobytes() for i in rest], pa.binary()), "won": pa.nulls(len(rest), old.type), "n": pa.nulls(len(rest), pa.int64()), "old": old.take(pa.array(rest)), "old_n": counts.take(pa.array(rest)), "member": pa.array(np.ones(len(rest), bool))})
            return pa.concat_tables([both, others])

        dealt = groups.withColumn("shard", _shard(F.col("digest"), self.shards)).groupBy("shard")
        merged = dealt.cogroup(self.table.groupBy("shard")).applyInArrow(find, f"digest binary, won {self.won}, n long, old {self.won}, old_n long, member boolean")
        zero = F.lit(0).cast("long")
        return merged.select("digest", F.greatest("won", "old").alias("won"), (F.coalesce("n", zero) + F.coalesce("old_n", zero)).alias("n"), "member")


def deduplicate(docs: DataFrame, historical: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs, with `member` (was the text in the history?).

    historical: which rows of docs are the history that is indexed; null counts as false. It decides what is looked up where,
    not the result."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest"), F.coalesce(historical, F.lit(False)).alias("old"))
    rows = stored(rows, "exact-rows")
    before, later = (stored(grouped(rows.where(side)), f"exact-{side[-3:]}") for side in ("old", "NOT old"))
    index = Index(before, max(before.count(), later.count()))
    groups = stored(index.lookup(later), "exact-groups")
    discard(before, later, index.table)
    each = hot_join(rows.select("doc_id", "row", "digest"), groups, ["digest"], "n")
    won = F.col("won.doc_id")
    return each.select("doc_id", won.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("won.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")
