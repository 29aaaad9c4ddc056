"""Quality scores by histogram gradient-boosted trees over statistics of a document.

The trees are grown in numpy from a bounded sample of labelled documents and flattened into arrays
(feature, threshold, left child, value), which a batch of documents walks level by level.

Defined cases: a null text counts as empty; an empty text has the statistics of no words and is
scored like any other; without labels of both kinds every score is the share of label 1 (0.5 if
there is none); a document labelled more than once counts with its largest label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import bounded_sample, fold_of, pieces, short_batches, utf8_view

#: At most about so many labelled documents are learned from.
SAMPLE = 12_000
ACCEPT = 0.7
BINS, TREES, DEPTH, RATE, LEAST_LEAF = 48, 80, 4, 0.12, 15

#: Shares of bytes: name -> which byte values.
SHARES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 32),
    "newline": (10, 13),
    "stop": (46, 44, 59, 58),
    "mark": (33, 63),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126),
    "high": range(128, 256),
}
FEATURES = ["log_bytes", *SHARES, "entropy", "most_common_byte", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "most_repeated_neighbours", "log_lines", "distinct_lines", "words_per_line"]


def _distinct(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n owners has."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, of))
    v, o = values[order], of[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    return np.bincount(o[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) over the whole of each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256)
    total = np.maximum(sizes, 1)
    share = counts / total[:, None]
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes, length, at = textnum.words(folded, offsets)
    n_words = np.diff(at)
    word_of = np.repeat(np.arange(n), n_words)
    per = lambda x: np.bincount(word_of, x, minlength=n) / np.maximum(n_words, 1)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    line_of = np.minimum(np.searchsorted(offsets, starts, "right") - 1, max(n - 1, 0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.uint64(0x9E3779B97F4A7C15) ^ (hashes >> np.uint64(7)))])
    position = np.cumsum(np.concatenate([[0], textnum._IS_WORD[folded] & ~np.concatenate([[False], textnum._IS_WORD[folded][:-1]])])) if len(data) else np.zeros(1, int)
    line_hash = sums[np.minimum(position[ends], len(hashes))] - sums[np.minimum(position[starts], len(hashes))] if len(ends) else np.zeros(0, np.uint64)
    lines = np.bincount(line_of, minlength=n) if len(ends) else np.zeros(n)
    columns = [
        np.log1p(sizes),
        *(share[:, list(x)].sum(axis=1) for x in SHARES.values()),
        -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1),
        share.max(axis=1, initial=0),
        np.log1p(n_words),
        per(length),
        per(length <= 2),
        per(length >= 12),
        _distinct(hashes, word_of, n) / np.maximum(n_words, 1),
        per(same),
        np.log1p(lines),
        _distinct(line_hash, line_of, n) / np.maximum(lines, 1),
        n_words / np.maximum(lines, 1),
    ]
    return np.stack(columns, axis=1)


class Trees:
    """Complete binary trees in flat arrays: children of node i are 2i + 1 and 2i + 2.

    A node that was not split has an infinite threshold; values are those of the last level."""

    def __init__(self, base: float):
        self.base = base
        inner = 2**DEPTH - 1
        self.feature = np.zeros((0, inner), np.int32)
        self.threshold = np.zeros((0, inner))
        self.value = np.zeros((0, inner + 1))

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts log-loss; each level of a tree is chosen from histograms of gradients over binned statistics."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else 20.0 if y[0] else -20.0)
    share = float(y.mean())
    trees = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), trees.base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            size = n * x.shape[1] * BINS
            hist = [np.bincount(cell, np.repeat(w, x.shape[1]), minlength=size).reshape(n, x.shape[1], BINS).cumsum(axis=2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, cl), (ga, ha, ca) = hist, (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(cl < LEAST_LEAF) | (ca - cl < LEAST_LEAF)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6:
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, minlength=2**DEPTH) / (np.bincount(leaf, h, minlength=2**DEPTH) + 1)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    trees.feature, trees.threshold, trees.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return trees


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees learned from about `sample` labelled documents outside the held-out fold.

    Only the sample's statistics reach the driver. The sampled labels (two numbers a row) are
    broadcast: `sample` bounds them."""
    short_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.coalesce(fold_of(F.col("doc_id")) != 2, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded_sample(known, ["doc_id"], sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _measured(b.column(0)):
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "h", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id", "text").alias("h"))
    # An id may have many rows.
    got = rows.mapInArrow(measure, "quality int, h long, x binary").orderBy("h", "quality", "x").limit(sample).collect()
    got.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got)).reshape(-1, len(FEATURES))
    return grow(x, np.array([r["quality"] for r in got], float))


def _measured(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = utf8_view(texts)
    out = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets, 1 << 18)]
    if out:
        yield np.concatenate(out)


def scored(text: Column, trees: Trees) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = [trees.scores(x) for x in _measured(batch)]
            yield pa.array(x[0] if x else [], pa.float64())

    return score(text)


def score_documents(docs: DataFrame, trees: Trees, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; a null id is not held out."""
    held = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), scored(F.col("text"), trees).alias("score")).withColumn("predicted", (F.col("score") >= accept).cast("int"))
