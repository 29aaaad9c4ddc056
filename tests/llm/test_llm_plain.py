"""Statistics, trees, chunks and media features against plain loops; empty tables and broken files."""

import hashlib
import io
import math
import random
import re
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdance.llm import language, media, quality, textnum, warc
from verdance.llm.common import utf8_view

TEXTS = ["", "Plain words, plain words; A B c 12345\nsecond line\nsecond line\n", "\n\nleading\n\n", "ÉTÉ naïve 日本 " * 40, "#$%^&* ~~ --", "x" * 5000, "one\ntwo\none\n\nTwo", "a b a b a b", None, "\t \r\n", "internationalization " * 9 + "?!"]


def plain_statistics(text):
    b = (text or "").encode()
    n = max(1, len(b))
    counts = [b.count(bytes([k])) for k in range(256)]
    folded = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [(m.start(), m[0]) for m in re.finditer(rb"[0-9a-z_\x80-\xff]+", folded)]
    w = [x for _, x in words]
    m = max(1, len(w))
    ends = sorted({i for i, c in enumerate(b) if c == 10 and i > 0} | ({len(b)} if b else set()))
    lines = [tuple(sorted(x for s, x in words if a <= s < e)) for a, e in zip([0, *ends], ends)]
    k = max(1, len(lines))
    return [
        math.log1p(len(b)), *(sum(counts[c] for c in x) / n for x in quality.SHARES.values()), -sum(c / n * math.log2(c / n) for c in counts if c), max(counts) / n, math.log1p(len(w)),
        sum(map(len, w)) / m, sum(len(x) <= 2 for x in w) / m, sum(len(x) >= 12 for x in w) / m, len(set(w)) / m, sum(x == y for x, y in zip(w, w[1:])) / m, math.log1p(len(lines)), len(set(lines)) / k, len(w) / k,
    ]


def test_statistics_against_plain_loops():
    got = quality.statistics(*utf8_view(pa.array(TEXTS, pa.string())))
    assert np.allclose(got, [plain_statistics(t) for t in TEXTS], atol=1e-9)


def test_scores_against_a_walk_down_each_tree(spark):
    r = np.random.default_rng(2)
    x = np.stack([plain_statistics("".join(chr(r.integers(97, 123 - 10 * (k % 2))) if r.random() < 0.8 else " " for _ in range(r.integers(20, 400)))) for k in range(400)])
    trees = quality.grow(x, np.arange(400) % 2.0)
    assert len(trees.feature) == quality.TREES
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[1]), (None, TEXTS[1])], "doc_id long, text string")
    got = quality.score_documents(docs, trees).collect()
    for row in got:
        s = plain_statistics(TEXTS[row["doc_id"]] if row["doc_id"] not in (0, None) else None if False else TEXTS[row["doc_id"] or 0])
        if row["doc_id"] in (0, None):
            continue
        raw = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if s[feature[node]] > threshold[node] else 1)
            raw += value[node - len(feature)]
        assert abs(row["score"] - 1 / (1 + math.exp(-raw))) < 1e-9 and row["predicted"] == int(row["score"] >= 0.7)
    copies = {row["score"] for row in got if row["doc_id"] in (1, None)}
    assert len(copies) == 1
    none = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_documents(docs.limit(0), none).collect() == []


def plain_chunks(payload):
    """The gear hash byte by byte; a chunk ends where its last byte's hash has the zero bits, or at its most bytes."""
    out, start, h = [], 0, 0
    for i, b in enumerate(payload):
        h = (2 * h + int(media._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        rest_is_long = len(payload) - start > media.LEAST
        if rest_is_long and ((size >= media.LEAST and h & int(media._ZERO_BITS) == 0) or size == media.MOST):
            out.append(payload[start : i + 1])
            start = i + 1
    return [*out, payload[start:]] if start < len(payload) else out


@pytest.mark.parametrize("n", [1, 64, 1024, 1088, 50_000, 200_000])
def test_cuts_against_a_byte_by_byte_hash(n):
    r = random.Random(n)
    payload = media.padded(bytes(r.choices(b"abcdefgh \n", k=n)))
    ends = media.cuts(payload)
    assert [payload[a:b] for a, b in zip([0, *ends], ends)] == plain_chunks(payload)


def test_stored_form_and_feature(spark):
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh \nÄ", k=30_000))
    texts = [*TEXTS, passage, passage + "tail", "head" + passage, passage, "z" * 100_000]
    docs = spark.createDataFrame([(k, t, "d", 1) for k, t in enumerate(texts)] + [(3, texts[3], "d", 1)], "doc_id long, text string, media string, parts int")
    got = media.media_columns(docs).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        data = (texts[x["doc_id"]] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        assert x["media_sha256"] == hashlib.sha256(file.getvalue()).hexdigest() and x["media_bytes"] == len(file.getvalue())
        mean, std, crossing, chunks = x["feature"].split(",")
        m = sum(payload) / len(payload)
        assert abs(float(mean) - m) < 1e-5 and abs(float(std) - math.sqrt(sum((b - m) ** 2 for b in payload) / len(payload))) < 1e-5
        assert abs(float(crossing) - sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:])) / (len(payload) - 1)) < 1e-5
        assert int(chunks) == len(plain_chunks(payload))
    assert media.media_columns(docs.limit(0)).collect() == []


@pytest.mark.parametrize("harm", ["missing", "changed", "digest"])
def test_a_broken_file_is_an_error(spark, harm):
    files, chunks = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    part = F.col("parts")[0]
    bad = {"missing": F.lit(None).cast("binary"), "changed": F.expr("parts[0].bytes")}.get(harm, part["bytes"])
    parts = F.array(F.struct((F.unhex(F.lit("00" * 32)) if harm == "changed" else part["digest"]).alias("digest"), bad.alias("bytes")))
    sha = F.unhex(F.lit("11" * 32)) if harm == "digest" else F.col("file_sha256")
    with pytest.raises(Exception, match="missing from the store|have its digest"):
        media.measure(files.withColumns({"parts": parts, "file_sha256": sha}), "doc_id").collect()


def test_repeated_and_null_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "other"), (None, "u", "same"), (None, "v", "alone"), (7, None, None), (7, None, ""), (3, "u", "x" * 400_000)]
    got = warc.archive(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_digest int")).collect()
    assert len(got) == len(rows)
    kinds = sorted(((x["page_id"], x["payload_bytes"], x["record_type"], x["refers_to"]) for x in got), key=repr)
    assert kinds == sorted([(1, 4, "response", None), (1, 4, "response", None), (2, 5, "response", None), (None, 4, "revisit", 1), (None, 5, "response", None), (7, 0, "response", None), (7, 0, "response", None), (3, 400_000, "response", None)], key=repr)


def test_language_of_very_long_texts_and_empty_table(spark):
    net = language.Network(["a", "b"], seed=1)
    long = "wörter und mehr " * 40_000
    docs = spark.createDataFrame([(1, long, 5), (2, long, 5), (3, "1 2 3", 5)], "doc_id long, text string, score int")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict_documents(docs, net).collect()}
    assert got[1] == got[2] and got[1][0] in "ab" and got[3] == ("und", 0.0)
    assert language.predict_documents(docs.limit(0), net).collect() == [] and language.reject(docs.limit(0), net).collect() == []


def test_hashes_of_spans_and_runs():
    data, offsets = utf8_view(pa.array(["one two one", "", "two one two"]))
    hashes, _, at = textnum.words(data, offsets)
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0] and list(at) == [0, 3, 3, 6]
    pairs, of = textnum.runs_of(hashes, at, 2)
    assert list(of) == [0, 2, 2, 4] and pairs[0] == pairs[3] and pairs[1] == pairs[2] != pairs[0]
    whole, _ = textnum.shingles(*textnum.words(*utf8_view(pa.array(["one two"])))[::2])
    assert whole[0] == pairs[0]
