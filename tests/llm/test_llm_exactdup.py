"""Exact dedup against plain Python, and its hash."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.llm import exactdup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("seed", range(3))
def test_hash_is_minimal_and_perfect(seed):
    words = np.random.default_rng(seed).integers(0, 2**63, (3000, 4), dtype=np.uint64)
    words[:1000, 0] = 5  # unequal digests that begin alike
    levels = exactdup.perfect_hash(words)
    assert sorted(exactdup.slots(words, levels)) == list(range(3000))
    assert exactdup.perfect_hash(words[:0]) == [] and list(exactdup.slots(words[:2], [])) == [-1, -1]


@pytest.mark.parametrize("historical", ["doc_id < 400", "true", "false", "cast(null as boolean)"])
def test_against_plain_python(spark, monkeypatch, historical):
    monkeypatch.setattr(exactdup, "KEYS_EACH", 16)
    r = random.Random(3)
    texts = [None, "", "Ärger", "ärger", "A b\nc", "a B\nC", "É", "x" * 200_000, "X" * 200_000, *(f"text {k}" for k in range(150))]
    rows = [(k, r.choice(texts)) for k in range(800)] + [(k, "copied Text") for k in range(800, 1200)] + [(7, "copied text"), (1199, "copied text"), (None, "alone"), (None, "copied text"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, b"d", i, 1) for i, t in rows], "doc_id long, text string, digest binary, won long, row int")
    got = exactdup.deduplicate(docs, F.expr(historical)).collect()
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got), key=repr) == sorted(expected(rows), key=repr)
    kept = [x for x in got if x["kept"]]
    assert len(kept) == len({x["text_sha256"] for x in got}) == len({x["text_sha256"] for x in kept}) and all(x["doc_id"] == x["keep_id"] for x in kept)
    if historical == "true":
        assert all(x["member"] for x in got)
    if historical == "false":
        assert not any(x["member"] for x in got)


def test_empty_table_and_ids_of_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exactdup.deduplicate(empty, F.lit(True)).collect() == []
    named = spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exactdup.deduplicate(named, F.col("doc_id") == "b").collect()) == [("a", "b", False), ("b", "b", True), ("c", "c", True)]
