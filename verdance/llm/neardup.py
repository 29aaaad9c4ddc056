"""Near duplicates by BagMinHash: weighted-Jaccard signatures of multisets of five-word shingles.

Signatures. Every shingle of weight w (how often it occurs) owns a Poisson process of points (time,
slot, level) whose levels are the discretised weights below w. The levels are a hierarchy of
dyadic ranges, 1, 1, 2, 4, ... wide; each range is one process of rate its width, and in the range
that w cuts, points at or above w are thinned out. So equal shingles share all points below the
lesser weight, and the slot minima of two texts agree with a chance that is their weighted Jaccard
similarity. Points are made in order of time up to a bound by which every slot is all but surely
filled; a text with an empty slot starts again with twice the bound, which changes no minimum.

Groups. Distinct texts are nodes; equal slots of a band put nodes in one bucket. A bucket doesn't make
all its pairs. It has two hubs: the node that meets most others in all its buckets, and the least of
those that meet half as many or more. Every node is compared with the best hub of either kind that it
meets; links are verified on the multisets themselves, and connected. Nodes of buckets that still hold
different components are compared with these buckets' hubs, and connected. What is left are pairs of a
bucket in different components, since a pair inside a component can't change it. They aren't made
from the bucket either: pairs with a rare shingle in common meet on it, and others only if the
frequent shingles of both are enough for the overlap that texts of these sizes need (crossing()). A
pair is left out only if it can't be similar, so no link that would join two classes is lost, and
there is no cap.

Defined cases: a null text is its own class; equal texts are one class, empty ones too; a text of
one to four words is one shingle of all of them; texts without words are alike only if equal; the
class id is the least doc_id of the class, and class_key tells classes apart where ids are null or
repeated."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import discard, hot_join, pieces, short_batches, stored, text_md5, unused, utf8_view, worker_tables

SIMILAR = 0.8
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share of slots are not similar: six standard deviations below SIMILAR.
LIKELY = 0.6
#: Bounds from sizes are lower by this share of the sizes, so that rounding drops no pair of similarity exactly SIMILAR.
SLACK = 1e-9
#: A shingle that more open nodes have is frequent.
RARE = 8
#: Sizes of one class are less than this factor apart.
SIZE_CLASS = 1.05
#: Bytes of text that a task has in hand at once, as shingles.
PIECE = 1 << 18
#: Words of 64 bits of the Bloom filter of nodes whose texts are needed: 2 MB.
WORDS = 1 << 18
_U = np.uint64


def weighted(sh: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and weight of the distinct shingles of each text, in order of owner and shingle."""
    owner = np.repeat(np.arange(len(so) - 1), np.diff(so))
    top = (owner.astype(np.uint64) << _U(40)) | (sh >> _U(24))
    order = np.argsort(top)
    s, o, top = sh[order], owner[order], top[order]
    if len(so) > 1 << 24 or ((top[1:] == top[:-1]) & (s[1:] != s[:-1])).any():  # shingles that differ in their last bits only
        order = np.lexsort((sh, owner))
        s, o = sh[order], owner[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) | (o[1:] != o[:-1])]))
    return o[new], s[new], np.diff(np.concatenate([new, [len(s)]]))


def signatures(sh: np.ndarray, so: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) minima, as 16 bits of each; texts without shingles have none to speak of."""
    n = len(so) - 1
    owner, shingle, weight = weighted(sh, so)
    # One process for each dyadic range of levels that a weight reaches.
    ranges = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else weight
    at = np.repeat(np.arange(len(weight)), ranges)
    level = np.arange(len(at)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    of, limit = owner[at], weight[at]
    key = textnum.mix(shingle[at] + level.astype(np.uint64) * _U(0x9FB21C651E98DF25))
    total = np.maximum(np.diff(so), 1)
    bound = SLOTS * (np.log(SLOTS) + 4) / total
    least = np.full(n * SLOTS, np.inf)
    todo = np.arange(len(at))
    while len(todo):
        time, step = np.zeros(len(todo)), 0
        alive = todo
        until = bound[of[alive]]
        while len(alive):
            step += 1
            r = textnum.mix(key[alive] + _U(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((r >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / width[alive]
            go = time <= until
            alive, time, until, r = alive[go], time[go], until[go], r[go]
            if not len(alive):
                break
            r = textnum.mix(r ^ _U(0xA0761D6478BD642F))
            slot = ((r >> _U(32)) * _U(SLOTS)) >> _U(32)
            where = low[alive] + (((r & _U(0xFFFFFFFF)) * width[alive].astype(np.uint64)) >> _U(32)).astype(np.int64)
            ok = where < limit[alive]
            np.minimum.at(least, of[alive[ok]] * SLOTS + slot[ok].astype(np.int64), time[ok])
        empty = np.isinf(least.reshape(n, SLOTS)).any(axis=1) & (np.diff(so) > 0)
        todo = todo[empty[of[todo]]]
        bound[empty] *= 2
    return (textnum.mix(least.view(np.uint64)) >> _U(48)).astype("<u2").reshape(n, SLOTS)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, at = textnum.words(data, offsets)
    return textnum.shingles(hashes, at)


SIGNED = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])


@F.arrow_udf(SIGNED)
def _signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signature and number of shingles of each text in lower case; no signature for texts without words."""
    worker_tables("neardup")
    for batch in batches:
        data, offsets = utf8_view(batch)
        out: list[bytes | None] = []
        sizes: list[int] = []
        for i, j in pieces(offsets, PIECE):
            sh, so = _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [x.tobytes() if k else None for x, k in zip(signatures(sh, so), np.diff(so))]
            sizes += np.diff(so).tolist()
        yield pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=SIGNED.names)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (shingles in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


@F.arrow_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Weighted Jaccard similarity of the whole multisets of two texts in lower case."""
    worker_tables("neardup")
    for left, right in batches:
        a, x = utf8_view(left)
        b, y = utf8_view(right)
        out: list[float] = []
        for i, j in pieces(x + y, PIECE):
            sides = []
            for data, offsets in ((a, x), (b, y)):
                o, s, w = weighted(*_hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                cut = np.searchsorted(o, np.arange(j - i + 1))
                sides.append([(s[f:t], w[f:t]) for f, t in zip(cut, cut[1:])])
            out += [overlap(s, t) for s, t in zip(*sides)]
        yield pa.array(out, pa.float64())


def _agreement(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.substring(a, 2 * k + 1, F.lit(2)) == F.substring(b, 2 * k + 1, F.lit(2)))
    return F.size(same) / SLOTS


def _number(node: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(node, at, size)), 16, 10).cast("long")


def _word(node: Column) -> Column:
    return _number(node, 1, 4) % WORDS


def _mask(node: Column) -> Column:
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (_number(node, at, 1) % 64).cast("int"))
    return reduce(Column.bitwiseOR, map(bit, (5, 6, 7, 8)))


def _bloom(nodes: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of nodes, as its filled words (word, bits): at most WORDS."""
    node = F.col(column)
    return nodes.select(_word(node).alias("word"), _mask(node).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node of the edges (a, b).

    Least labels spread over the edges and then jump to their labels' labels, so rounds grow with
    the logarithm of a component's width. Each round is written to the shared folder."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "dup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = stored(labels.join(near, "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old")), "dup-labels")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = stored(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"), "dup-labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels, step)
        labels = new
        if not changed:
            discard(both)
            return labels


class Groups:
    """The steps of a search over docs; `labels` is its result."""

    def __init__(self, docs: DataFrame, similar: float = SIMILAR):
        self.similar = similar
        self.steps: list[DataFrame] = []
        short_batches(docs.sparkSession)
        self.texts = docs.where("text IS NOT NULL").select(text_md5(F.col("text")).alias("node"), F.lower("text").alias("t"))
        signed = self.texts.select("node", _signature("t").alias("x")).where("x.sig IS NOT NULL")
        self.nodes = stored(signed.groupBy("node").agg(F.first("x").alias("x")).select("node", "x.*"), "dup-nodes")
        width = ROWS * 2
        bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))
        rows = self.nodes.select("node", F.explode(bucket).alias("bucket"))
        many = self._kept(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dup-buckets")
        self.members = stored(hot_join(rows, many, ["bucket"], "n"), "dup-members")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that lasts until the step's links are written."""
        self.steps.append(stored(df, name))
        return self.steps[-1]

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The verified pairs, written; the tables of the step go."""
        out = stored(self.verified(pairs), "dup-links")
        discard(*self.steps)
        self.steps.clear()
        return out

    def hubs(self, rows: DataFrame) -> DataFrame:
        """Each of rows (bucket, node, n) with the two hubs of its bucket, as (leaf, rank, hub); rank is less for better hubs."""
        met = rows.groupBy("node").agg(F.sum("n").alias("met"))
        most = F.struct((-F.col("met")).alias("r"), F.col("node").alias("hub"))
        least = F.struct((-F.floor(F.log2("met"))).alias("r"), F.col("node").alias("hub"))  # among nodes that meet about as many, the same one leads most of their buckets
        each = rows.join(met, "node").groupBy("bucket").agg(F.min(most).alias("most"), F.min(least).alias("least"), F.first("n").alias("n"))
        each = self._kept(each, "dup-hubs")
        return hot_join(rows.select("bucket", "node"), each, ["bucket"], "n").select(F.col("node").alias("leaf"), "most", "least")

    def first_stars(self) -> DataFrame:
        """Each member with the best hub of either kind over all its buckets, as (leaf, hub)."""
        best = lambda kind: F.min(F.when(F.col(f"{kind}.hub") != F.col("leaf"), F.col(kind)))["hub"]
        ends = self.hubs(self.members).groupBy("leaf").agg(F.array(best("most"), best("least")).alias("hubs"))
        return self._kept(ends.select("leaf", F.explode(F.array_distinct(F.array_compact("hubs"))).alias("hub")), "dup-stars")

    def open_rows(self, labels: DataFrame) -> DataFrame:
        """The members (bucket, node, label, n) of buckets that hold more than one component; n counts the bucket's members."""
        rows = self.members.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
        return self._kept(hot_join(rows, self._kept(mixed, "dup-mixed"), ["bucket"], "n"), "dup-open")

    def stars(self, labels: DataFrame) -> DataFrame:
        """Each member of an open bucket with both hubs of all its open buckets, where they are of another component."""
        rows = self.open_rows(labels)
        pairs = self.hubs(rows).select("leaf", F.explode(F.array_distinct(F.array("most.hub", "least.hub"))).alias("hub")).where("leaf <> hub").distinct()
        of = self._kept(rows.select("node", "label").distinct(), "dup-of")
        weights = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(of.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub")
        both = hot_join(pairs, weights, ["hub"], "n").join(of.withColumnRenamed("node", "leaf"), "leaf")
        return self._kept(both.where("label <> hub_label").select("leaf", "hub"), "dup-stars")

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """node and text (t) of the given distinct nodes.

        A Bloom filter of fixed size goes to the scan, so that few other texts are shuffled."""
        node = F.col("node")
        some = self.texts.select("node", "t", _word(node).alias("word"), _mask(node).alias("mask")).join(F.broadcast(_bloom(nodes, "node")), "word").where("bits & mask = mask").select("node", "t")
        return self._kept(some.groupBy("node").agg(F.first("t").alias("t")).join(nodes, "node"), "dup-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (leaf, hub) whose multisets are similar, as edges (a, b)."""
        weights = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(self.nodes.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
        both = hot_join(pairs, weights, ["hub"], "n").join(self.nodes.select(F.col("node").alias("leaf"), "sig"), "leaf")
        likely = self._kept(both.where(_agreement(F.col("sig"), F.col("hub_sig")) >= LIKELY).select("leaf", "hub"), "dup-likely")
        ends = likely.select(F.col("leaf").alias("node")).unionByName(likely.select(F.col("hub").alias("node"))).distinct()
        texts = self._texts(ends)
        checked = likely.join(texts.select(F.col("node").alias("leaf"), F.col("t").alias("u")), "leaf").join(texts.select(F.col("node").alias("hub"), "t"), "hub")
        return checked.where(_similarity("u", "t") >= self.similar).select(F.col("leaf").alias("a"), F.col("hub").alias("b"))

    def crossing(self, labels: DataFrame) -> DataFrame:
        """All pairs of open buckets' members that are of different components and could be similar.

        A shingle counts if another component has it too. Pairs that share one that RARE nodes at most have meet on it. The
        overlap of any other pair is made of frequent shingles alone; such pairs meet in their buckets if both have enough
        of these for the sizes of both."""
        rows = self.open_rows(labels).drop("n")
        each = self._shingles(rows.groupBy("node").agg(F.min("label").alias("label")))
        span = each.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("shingle", "n")
        shared = self._kept(hot_join(each, self._kept(span, "dup-spans"), ["shingle"], "n"), "dup-shared")
        rare = shared.where(F.col("n") <= RARE)
        meet = rare.alias("a").join(rare.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.label") < F.col("b.label"))).select(F.col("a.node").alias("leaf"), F.col("b.node").alias("hub"))
        reach = shared.where(F.col("n") > RARE).groupBy("node").agg(F.first("size").alias("size"), F.sum("w").alias("frequent"))
        near = self._near(self._kept(rows.join(reach, "node"), "dup-reach"))
        return self._kept(meet.unionByName(near).distinct(), "dup-crossing")

    def _near(self, rows: DataFrame) -> DataFrame:
        """Pairs (leaf, hub) of rows (bucket, node, label, size, frequent) whose frequent shingles could be overlap enough.

        An overlap o of sizes a and b is similar if o >= s * (a + b - o). So a node's frequent shingles bound the sizes of
        its partners; it meets only those whose class of size is within its bounds, and whose bounds have its own class."""
        s = self.similar - SLACK
        size, top = F.col("size"), F.col("frequent") * (1 + s) / s - F.col("size")
        class_of = lambda c: F.floor(F.log(F.greatest(c, F.lit(0.5))) / F.log(F.lit(SIZE_CLASS))).cast("int")
        each = rows.where(top >= size * s).withColumns({"own": class_of(size), "other": F.explode(F.sequence(class_of(size * s), class_of(top * (1 + SLACK))))})
        both = ["bucket", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large")]
        open_ = each.groupBy(*both).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "small", "large")
        each = self._kept(each.select("*", *both[1:]).join(open_, ["bucket", "small", "large"], "left_semi"), "dup-classes")
        a, b = each.alias("a"), each.alias("b")
        same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
        enough = F.least("a.frequent", "b.frequent") * (1 + s) >= s * (F.col("a.size") + F.col("b.size"))
        return a.join(b, same & (F.col("a.label") < F.col("b.label")) & enough).select(F.col("a.node").alias("leaf"), F.col("b.node").alias("hub"))

    def _shingles(self, nodes: DataFrame) -> DataFrame:
        """node, label, size, shingle and its weight w of all shingles of nodes (node, label)."""

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_tables("neardup")
            for b in batches:
                data, offsets = utf8_view(b.column(2))
                for i, j in pieces(offsets, PIECE):
                    o, s, w = weighted(*_hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    sizes = np.bincount(o, w, minlength=j - i).astype(np.int64)
                    at = pa.array(o + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sizes[o]), pa.array(s.view(np.int64)), pa.array(w.astype(np.int64))], names=["node", "label", "size", "shingle", "w"])

        texts = self._texts(nodes.select("node")).join(nodes, "node").select("node", "label", "t")
        return self._kept(texts.mapInArrow(shingled, "node binary, label binary, size long, shingle long, w long"), "dup-shingles")

    def labels(self) -> DataFrame:
        """node and label of every text that is similar to another one."""
        found = [self._links(self.first_stars())]
        labels = components(found[0])
        for pairs in (self.stars, self.crossing):
            more = self._links(pairs(labels))
            if more.limit(1).count():
                discard(labels)
                found.append(more)
                labels = components(reduce(DataFrame.unionByName, found))
        discard(*found, self.nodes, self.members)
        return labels


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), class_size and class_key of every row of docs."""
    labels = Groups(docs, similar).labels()
    rows = docs.select("doc_id", text_md5(F.col("text")).alias("node"))
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    marked = sizes.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = stored(marked, "dup-marked")
    total = marked.groupBy("label").agg(F.min("m").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("w"))
    each = hot_join(marked.select("node", "label", "n"), total, ["label"], "w").select("node", "n", "class_id", "class_size", F.lower(F.hex("label")).alias("class_key"))
    known = hot_join(rows.where("node IS NOT NULL"), stored(each, "dup-classes"), ["node"], "n").select("doc_id", "class_id", "class_size", "class_key")
    return known.unionByName(rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("string").alias("class_key")))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that of least (doc_id, text MD5); rows without text all stay.

    Only rows whose text is in a class with another row are looked up, by way of a shuffle. A Bloom filter says of most
    others at the scan that they aren't, and they stay where they are."""
    labels = Groups(docs, similar).labels()
    firsts = docs.where("text IS NOT NULL").groupBy(text_md5(F.col("text")).alias("node")).agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("rows"))
    marked = stored(firsts.join(labels.select("node", "label"), "node", "left").select("node", "m", "rows", F.coalesce("label", "node").alias("label")), "dup-marked")
    classes = marked.groupBy("label").agg(F.min(F.struct("m", "node")).alias("first"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("w")).where("all > 1")
    shared = hot_join(marked, stored(classes, "dup-classes"), ["label"], "w").select("node", "rows", F.when(F.col("node") == F.col("first.node"), True).alias("stays"), F.col("first.m").alias("m"))
    shared = stored(shared, "dup-shared")
    node, word, mask, may, rows, stays, first = (unused(docs, c) for c in ("node", "word", "mask", "bits", "rows", "stays", "m"))
    keyed = docs.where("text IS NOT NULL").withColumn(node, text_md5(F.col("text")))
    keyed = keyed.withColumns({word: _word(F.col(node)), mask: _mask(F.col(node))})
    seen = keyed.join(F.broadcast(_bloom(shared, "node").select(F.col("word").alias(word), F.col("bits").alias(may))), word, "left")
    possible = F.coalesce(F.col(may).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    small = shared.select(F.col("node").alias(node), F.col("rows").alias(rows), F.col("stays").alias(stays), F.col("m").alias(first))
    found = hot_join(seen.where(possible), small, [node], rows, "left")
    one = found.where(F.col(rows).isNull() | (F.col(stays) & F.col("doc_id").eqNullSafe(F.col(first)))).dropDuplicates([node])
    parts = [seen.where(~possible), one, docs.where("text IS NULL")]
    return reduce(DataFrame.unionByName, (p.select(*docs.columns) for p in parts))
