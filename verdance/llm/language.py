"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows; each filter's maximum
over a window feeds a softmax. A text's windows tile all of it, and the mean of their logits
decides. Learning uses a bounded sample of the labelled texts of every language; every text is scored whole.

Defined cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn
from, every text is `und` with score 0; equal texts get equal predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, let, pieces, short_batches, unused, utf8_view, worker_tables

UNKNOWN = "und"
#: Bytes of a window; the last one of a text is filled up with zero bytes.
WINDOW = 256
#: So many labelled texts are learned from. A language gets its share of them, but TEXTS_EACH at least, or all that it has;
#: so rare ones are learned too. With many languages the least number is lower, so that all sum up to about MOST_TEXTS at most.
SAMPLE, TEXTS_EACH, MOST_TEXTS = 600, 100, 20_000
#: Windows of a text that are learned from, evenly spread over it; and languages: the most frequent ones (a column of labels
#: that has more isn't one of languages).
WINDOWS_EACH, MOST_LANGUAGES = 40, 1000
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
SPAN = max(WIDTHS)

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that tile each text, as rows of bytes, and the text of each."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // WINDOW))
    of = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][of] + start * WINDOW
    left = offsets[1:][of] - start
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    cut = left < WINDOW
    if cut.any():
        rows[cut] = np.where(np.arange(WINDOW) < left[cut][:, None], rows[cut], 0)
    return rows, of


class Network:
    """Embedding (256, E), one matrix of all filters (SPAN * E, F), bias, and the softmax layer.

    A filter narrower than SPAN has zeros at its end, kept by `mask`."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        f = len(WIDTHS) * FILTERS
        self.classes = classes
        self.mask = np.zeros((SPAN, EMBEDDING, f), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(SPAN * EMBEDDING, f)
        self.p = {
            "table": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask,
            "bias": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.1, (f, len(classes))).astype(np.float32),
            "out_bias": np.zeros(len(classes), np.float32),
        }

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """(windows, positions, SPAN * E): the embedded bytes under each place of the filters."""
        x = self.p["table"][rows]
        view = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1)  # (n, positions, E, SPAN)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(rows), -1, SPAN * EMBEDDING)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.mask.shape[1]), np.float32)
        for i in range(0, len(rows), 32):  # so few that their columns stay in the cache
            out[i : i + 32] = (self.columns(rows[i : i + 32]) @ self.p["filters"]).max(axis=1)
        return np.maximum(out + self.p["bias"], 0)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.pooled(rows) @ self.p["out"] + self.p["out_bias"]

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 3e-3, seed: int = 0) -> None:
        """Adam on cross-entropy; the gradient of a maximum goes to its place."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                cols = self.columns(rows[at])
                z = cols @ p["filters"]
                top = z.argmax(axis=1)
                raw = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p["bias"]
                h = np.maximum(raw, 0)
                logit = h @ p["out"] + p["out_bias"]
                prob = np.exp(logit - logit.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                prob[np.arange(len(at)), labels[at]] -= 1
                prob /= len(at)
                dh = (prob @ p["out"].T) * (raw > 0)
                won = np.take_along_axis(cols, top[:, :, None], 1)  # (n, F, SPAN * E)
                dcols = dh[:, :, None] * p["filters"].T[None]
                dtable = np.zeros_like(p["table"])
                places = rows[at][np.arange(len(at))[:, None, None], top[:, :, None] + np.arange(SPAN)]
                np.add.at(dtable, places.reshape(-1), dcols.reshape(-1, EMBEDDING))
                g = {"table": dtable, "filters": np.einsum("nf,nfk->kf", dh, won) * self.mask, "bias": dh.sum(0), "out": h.T @ prob, "out_bias": prob.sum(0)}
                step += 1
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _sampled(known: DataFrame, sample: int) -> DataFrame:
    """lang and text of the rows of known whose hash of doc_id and text is lowest in their lang: its share of `sample`, or the least number of texts.

    Hashes alone are ranked, cut before the shuffle at the largest share, so a language of any size sends so many numbers a
    task; each language's last hash then picks the rows."""
    by_size = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in by_size.collect()}
    total = sum(counts.values())
    if not total:
        return known.select("lang", "text")
    least = min(TEXTS_EACH, max(1, MOST_TEXTS // len(counts)))
    quota = {lang: min(n, max(-(-sample * n // total), least)) for lang, n in counts.items()}
    per_lang = known.sparkSession.createDataFrame(sorted(quota.items()), "lang string, quota long")
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit(7)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = hashed.select("lang", "h", rank.alias("rank")).where(F.col("rank") <= max(quota.values()))
    edge = first.join(F.broadcast(per_lang), "lang").where("rank <= quota").groupBy("lang").agg(F.max("h").alias("edge"))
    # Rows alike have one hash, and count once.
    chosen = hashed.join(F.broadcast(edge), "lang").where("h <= edge")
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def _learned(text: Column) -> Column:
    """The windows of a text that are learned from, as bytes: all, or WINDOWS_EACH of them evenly spread."""

    def cut(b: Column) -> Column:
        n = F.greatest(F.ceil(F.length(b) / WINDOW), F.lit(1))
        some = F.least(n, F.lit(WINDOWS_EACH))
        return F.transform(F.sequence(F.lit(0).cast("long"), some - 1), lambda k: F.substring(b, (F.floor(k * n / some) * WINDOW + 1).cast("int"), F.lit(WINDOW)))

    return let(text.cast("binary"), cut)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network learned from texts with a non-null lang outside the held-out fold; None if there are none.

    It knows the languages of those texts, the MOST_LANGUAGES most frequent if there are more. What reaches the driver
    are windows of the sampled texts (_sampled): about MOST_TEXTS * WINDOWS_EACH * WINDOW bytes at most, 205 MB, whatever the input."""
    short_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold_of(F.col("doc_id")) != 2, F.lit(False)))
    got = sorted((r["lang"], bytes(w)) for r in _sampled(known, sample).select("lang", _learned(F.col("text")).alias("windows")).collect() for w in r["windows"])
    if not got:
        return None
    classes = sorted({lang for lang, _ in got})
    net, number = Network(classes), {c: i for i, c in enumerate(classes)}
    rows = np.zeros((len(got), WINDOW), np.uint8)
    for row, (_, w) in zip(rows, got):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    net.train(rows, np.array([number[lang] for lang, _ in got]))
    return net


def predicted(text: Column, net: Network | None) -> Column:
    """A struct of lang_pred and score for each text."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_tables("language")
        for batch in batches:
            data, offsets = utf8_view(batch)
            best, score = np.zeros(len(batch), int), np.zeros(len(batch))
            for i, j in pieces(offsets, 1 << 18):
                rows, of = windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                logits = np.zeros((j - i, len(net.classes)))
                np.add.at(logits, of, net.logits(rows))
                logits /= np.bincount(of, minlength=j - i)[:, None]
                prob = np.exp(logits - logits.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                best[i:j], score[i:j] = prob.argmax(axis=1), prob.max(axis=1)
            langs, scores = [], []
            for text, b, s in zip(batch, best, score):
                ok = any(map(str.isalpha, text.as_py() or ""))
                langs.append(net.classes[b] if ok else UNKNOWN)
                scores.append(float(s) if ok else 0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=RESULT.names)

    return predict(text)


def predict_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs; a null id is not held out."""
    held = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predicted(F.col("text"), net).alias("x")).select("doc_id", "held_out", "x.*")


def reject(docs: DataFrame, net: Network | None, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is unknown or scored below `least`; all columns stay.

    Where nothing could be learned (net is None) no language is worse than another, so every text with a letter stays."""
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = unused(docs, "lang")
    kept = docs.withColumn(name, predicted(F.col("text"), net))
    return kept.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
