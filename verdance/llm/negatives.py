"""Hard-negative mining by exact inner products, pruned in a rotated space.

A component x becomes floor(256 * x), so scores are whole numbers. The rows' second moments give an
orthogonal matrix (their principal axes, leading first); it keeps inner products, and most of a product is
in its leading components. A task has a block of anchors, that is queries, and passes its rows by in pieces. It
multiplies the leading components of all pairs of anchor and row, adds and takes away the product of both rests' norms
(Cauchy and Schwarz) and some slack for rounding, and so has bounds of each score. Pairs that can't come in are dropped. The others
get the next components and narrower bounds; those that are left are multiplied in whole numbers, which alone
decide. The task keeps each query's best so far, so bounds get narrower as it goes on; the tasks' bests meet in a window by
query that takes LIMIT rows a task and query at most.

A first search finds an anchor's positives, a second one the negatives in the score band of each of them. Anchors go
to the tasks in blocks of ANCHORS rows, a bounded broadcast; more anchors mean more passes over the rows,
which are whole numbers by then and aren't shuffled.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part;
vectors of unequal length count as filled up with zeros; a null id is no anchor and comes last in ties; of rows alike in score and
id the row number decides; a repeated row is another row, also as an anchor; an empty table gives no
row; products that don't fit 62 bits raise an error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares of the positive's, in hundredths.
LOW, HIGH = 50, 95
#: Anchors of a block; rows of a piece; anchors that are multiplied with a piece at once.
ANCHORS, PIECE, TILE = 1 << 14, 1024, 512
#: Leading components at each step, as shares of all.
STEPS = (0.25, 0.5)
#: Relative error that sums of products in double precision have at most, with room.
SLACK = 1e-10
FLOOR = np.iinfo(np.int64).min


def whole(vectors: DataFrame, relabel: bool = True) -> DataFrame:
    """row, id, label and v (array of whole numbers) of the rows that take part; relabel: ids divisible by 7 get the next label of ten."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform(x, lambda c: F.floor(256 * c).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The principal axes of rows, as columns, those of the largest second moment first. Tasks send their sums of products."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(float)
            total += m.T @ m
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, i, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(total[i])], names=["i", "j", "x"])

    sums = rows.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros((width, width))
    m[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


class Side:
    """Vectors with their rotated form and, for each step, the norm of what is beyond its leading components."""

    def __init__(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, v: np.ndarray, axes: np.ndarray):
        self.row, self.id, self.label, self.v = row, id_, label, v
        self.turned = v.astype(float) @ axes
        self.norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        self.cuts = [max(1, round(len(axes) * s)) for s in STEPS]
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)) * (1 + SLACK) + SLACK * self.norm for c in self.cuts]


class Best:
    """The `limit` best (score, id, row) of each query so far."""

    def __init__(self, queries: int, limit: int):
        self.limit = limit
        self.query = self.score = self.id = self.row = np.zeros(0, np.int64)
        self.least = np.full(queries, FLOOR)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        q, s, i, r = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((r, i, -s, q))
        q, s, i, r = (x[order] for x in (q, s, i, r))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(q)), bool), q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.limit
        full = rank == self.limit - 1
        self.least[q[full]] = s[full]
        self.query, self.score, self.id, self.row = (x[keep] for x in (q, s, i, r))


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The whole-number inner products of rows i of a with rows j of b."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]])
    return out


def compare(anchors: Side, low: np.ndarray, high: np.ndarray, same: bool, rows: Side, best: Best) -> int:
    """Puts into `best` the rows whose score with an anchor is within the bands low..high (anchors x bands) of its queries, and returns how many
    pairs were multiplied in whole numbers. Query number: anchor times bands plus band. same: rows of the anchor's label, but itself; else of other labels."""
    bands, verified = low.shape[1], 0
    most = np.abs(anchors.v).max(initial=0).astype(float) * np.abs(rows.v).max(initial=0) * max(1, rows.v.shape[1])
    if most >= 2.0**62:
        raise ValueError("components are too large for whole-number scores")
    for t in range(0, len(anchors.row), TILE):
        part = slice(t, t + TILE)
        alike = anchors.label[part, None] == rows.label
        ok = alike & (anchors.row[part, None] != rows.row) if same else ~alike
        least = np.maximum(low[part], best.least.reshape(-1, bands)[part]).min(axis=1)
        top = high[part].max(axis=1)
        c = anchors.cuts[0]
        sums = anchors.turned[part, :c] @ rows.turned[:, :c].T
        slack = SLACK * anchors.norm[part, None] * rows.norm + SLACK
        bound = anchors.rest[0][part, None] * rows.rest[0] + slack
        i, j = np.nonzero(ok & (sums + bound >= least[:, None]) & (sums - bound <= top[:, None]))
        if len(anchors.cuts) > 1 and len(i):
            sums, slack = sums[i, j], slack[i, j]
            for step, (c, d) in enumerate(zip(anchors.cuts, anchors.cuts[1:]), 1):
                sums = sums + np.einsum("ij,ij->i", anchors.turned[part][i, c:d], rows.turned[j, c:d])
                bound = anchors.rest[step][part][i] * rows.rest[step][j] + slack
                stay = (sums + bound >= least[i]) & (sums - bound <= top[i])
                i, j, sums, slack = i[stay], j[stay], sums[stay], slack[stay]
        score = products(anchors.v[part], rows.v, i, j)
        verified += len(i)
        for band in range(bands):
            query = (i + t) * bands + band
            inside = (score >= low[part][i, band]) & (score <= high[part][i, band]) & (score >= best.least[query])
            best.add(query[inside], score[inside], rows.id[j[inside]], rows.row[j[inside]])
    return verified


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def search(rows: DataFrame, sent: Broadcast, width: int, same: bool, limit: int) -> DataFrame:
    """query, row, id and score of each query's best rows. sent: (axes, anchors' row, id, label and v, low, high)."""

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, row, id_, label, v, low, high = sent.value
        anchors, best = Side(row, id_, label, v, axes), Best(low.size, limit)
        for b in batches:
            for k in range(0, b.num_rows, PIECE):
                p = b.slice(k, PIECE)
                compare(anchors, low, high, same, Side(p.column(0).to_numpy(), _ids(p.column(1)), p.column(2).to_numpy(), _matrix(p.column(3), width), axes), best)
        missing = best.id == np.iinfo(np.int64).max
        for k in range(0, len(best.query), 1 << 16):
            at = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(best.query[at]), pa.array(best.row[at]), pa.array(best.id[at], mask=missing[at]), pa.array(best.score[at])], names=["query", "row", "id", "score"])

    found = rows.mapInArrow(best_of, "query long, row long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def mine(vectors: DataFrame, every: int = 50, relabel: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors (ids divisible by `every`).

    vectors: vec_id, embedding and label; other columns don't matter."""
    spark = vectors.sparkSession
    rows = stored(whole(vectors, relabel), "vectors")
    chosen = rows.where(F.col("id") % every == 0)
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.sum(F.when(F.col("id") % every == 0, 1).otherwise(0)).alias("n")).collect()[0]
    width, blocks = facts["width"] or 1, -(-(facts["n"] or 0) // ANCHORS)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = [spark.createDataFrame([], schema)]
    axes = rotation(rows, width)
    for k in range(blocks):
        block = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        got = block.orderBy("row").toArrow()
        row, id_, label, v = got["row"].to_numpy(), got["id"].to_numpy(), got["label"].to_numpy(), _matrix(got["v"].combine_chunks(), width)
        if not len(row):
            continue
        open_ = (np.full((len(row), 1), FLOOR), np.full((len(row), 1), np.iinfo(np.int64).max))
        sent = spark.sparkContext.broadcast((axes, row, id_, label, v, *open_))
        pos = search(rows, sent, width, True, POSITIVES).toArrow()
        sent.destroy()
        query, rank, score = (pos[c].to_numpy() for c in ("query", "rank", "score"))
        low, high = np.full((len(row), POSITIVES), np.iinfo(np.int64).max), np.full((len(row), POSITIVES), FLOOR)  # bands that no score is in
        low[query, rank - 1], high[query, rank - 1] = -((-LOW * score) // 100), HIGH * score // 100
        sent = spark.sparkContext.broadcast((axes, row, id_, label, v, low, high))
        found = stored(search(rows, sent, width, False, NEGATIVES), "negatives")
        sent.destroy()
        table = pa.table({"query": pa.array(query * POSITIVES + rank - 1), "anchor_id": pa.array(id_[query]), "positive_id": pos["id"], "positive_score": pos["score"]})
        ends = spark.createDataFrame(table)
        out.append(found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(ends), "query").select(*out[0].columns))
    discard(rows)
    return reduce(DataFrame.unionByName, out)
