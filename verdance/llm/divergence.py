"""Source divergence audit: how far the sources of a language differ, and in which terms.

A language keeps the terms that LEAST of its documents have. Each (lang, source) group and each language gives
every kept term an integer share p of a thousand million, with 2 added to its count; two shares p and q differ by
(p - q)^2 / (p + q), rounded down. All arithmetic is in whole numbers.

Sketch. Most terms are too rare to be kept, so a first pass counts documents by language and term in a count-min
sketch: each task fills its own, and Spark adds up the cells that aren't zero. A cell counts all terms that fall
on it, so it never underestimates; a term with a cell below LEAST can't be kept. Cells of LEAST or more are sent to the
tasks as a bit each, ROWS * cells / 8 bytes whatever the input. The second pass drops impossible terms before the shuffle and
counts the others exactly; those that passed by chance go then. The sketch decides only what is shuffled. With more terms than
it can part, it drops fewer.

Pairs. Two sources' difference is a sum over all kept terms, most of which neither may have. Terms without
occurrences have one share p0 in a group. So the sum takes three sparse parts: the terms that both have, by a
join on the term, as a correction of the terms that one side has, by that side's histogram of shares (terms
with equal shares add alike), and the number of the others times the difference of both p0.

Defined cases: null text, lang and source are ''; a group without terms has the shares p0; a language without kept
terms has pairs of value 0; repeated rows count each; an empty table gives no row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import discard, hot_join, short_batches, stored, utf8_view

LEAST, TOP = 10, 10
#: Rows of the sketch, and cells of a row: 1 MB as bits.
ROWS, CELLS = 2, 1 << 22
#: Bytes of text that a task has in hand at once, as terms; a longer text stands alone.
PIECE = 8 << 20
#: Parts of a language's sources that meet in different tasks.
SALTS = 16
_U = np.uint64
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gathered(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.Table]:
    """Batches of (lang, source, text) as tables of about `most` bytes of text, sliced between texts."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The code of each value, and the values by code."""
    x = column.combine_chunks().dictionary_encode()
    return x.indices.to_numpy(zero_copy_only=False).astype(np.int64), x.dictionary


def _terms(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document, term code and occurrences of every term of every document, and the terms by code."""
    data, offsets = utf8_view(table["text"].combine_chunks())
    data = _LOWER[data]
    start, end, at = textnum.runs(data, offsets, _IS_TERM)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[_IS_TERM[data]])).dictionary_encode()
    codes, k = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(tokens.dictionary))
    pair, n = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * k + codes, return_counts=True)
    return pair // k, pair % k, n, tokens.dictionary


def _hashes(values: pa.Array) -> np.ndarray:
    data, offsets = utf8_view(values)
    return textnum.hashes_of(data, offsets[:-1], offsets[1:])


def _cells(langs: pa.Array, terms: pa.Array, lang: np.ndarray, term: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell in each row of the sketch of terms of languages, given by code."""
    h = textnum.mix(_hashes(terms)[term] + textnum.mix(_hashes(langs))[lang])
    return [row * cells + (((h >> _U(32 * row) & _U(0xFFFFFFFF)) * _U(cells)) >> _U(32)).astype(np.int64) for row in range(ROWS)]


def _summed(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, and for each the sum of each of the weights."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
    return s[first], *(np.add.reduceat(w[order], first) if len(s) else w for w in weights)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def possible(docs: DataFrame, least: int = LEAST, cells: int = CELLS) -> np.ndarray:
    """A bit for each cell of the merged sketch, packed: does it count `least` documents or more?"""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * cells, np.int64)
        for table in _gathered(batches):
            lang, langs = _values(table["lang"])
            doc, term, _, terms = _terms(table)
            k = max(1, len(terms))
            key, n = _summed(lang[doc] * k + term, np.ones(len(doc), np.int64))
            for at in _cells(langs, terms, key // k, key % k, cells):
                np.add.at(counts, at, n)
        filled = np.flatnonzero(counts)
        for i in range(0, len(filled), 1 << 16):
            part = filled[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["cell", "n"])

    full = _read(docs).mapInArrow(sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell") % 64)
    found = full.groupBy(F.floor(F.col("cell") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(ROWS * cells // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words


def counted(docs: DataFrame, words: np.ndarray, cells: int = CELLS) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of the terms that the sketch lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            lang, langs = _values(table["lang"])
            source, sources = _values(table["source"])
            doc, term, n, terms = _terms(table)
            k, s = max(1, len(terms)), len(sources)
            key, n, docs_with = _summed((lang[doc] * s + source[doc]) * k + term, n, np.ones(len(doc), np.int64))
            pass_ = np.ones(len(key), bool)
            for at in _cells(langs, terms, key // (s * k), key % k, cells):
                pass_ &= (sent.value[at >> 6] >> (at & 63)) & 1 == 1
            key, n, docs_with = key[pass_], n[pass_], docs_with[pass_]
            for i in range(0, len(key), 1 << 16):
                at = key[i : i + (1 << 16)]
                columns = [langs.take(pa.array(at // (s * k))), sources.take(pa.array(at // k % s)), terms.take(pa.array(at % k)).cast(pa.string()), pa.array(n[i : i + (1 << 16)]), pa.array(docs_with[i : i + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    rows = _read(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * terms)); null where there are no terms."""
    whole = f"1 + CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(19,0)) DIV CAST({total} + 2 * {terms} AS DECIMAL(19,0))"
    return F.when(F.col(terms) > 0, F.expr(whole))


def differ(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})")


def _pair_sums(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and value of pairs of groups, from rows (g, lang, term, p, p0) of terms that occur in groups."""
    a = rows.select("lang", "term", F.col("g").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = rows.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = a.join(b, ["lang", "term"]).where("a < b").select("a", "b", (differ("pa", "pb") - differ("pa", "zb") - differ("za", "pb") + differ("za", "zb")).alias("value"))
    neither = pairs.where("n_terms > 0").select("a", "b", ((F.col("n_terms") - F.col("ta") - F.col("tb")) * differ("za", "zb")).alias("value"))
    alike = rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("m"))
    sides = [pairs.select(F.col(g).alias("g"), "a", "b", F.col(z).alias("z")) for g, z in (("a", "zb"), ("b", "za"))]
    one = reduce(DataFrame.unionByName, sides).join(alike, "g").select("a", "b", (F.col("m") * differ("p", "z")).alias("value"))
    parts = [both, neither, one]
    return reduce(DataFrame.unionByName, (x.groupBy("a", "b").agg(F.sum("value").alias("value")) for x in parts)).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: every other source, and the `top` terms that a source has most more of."""
    short_batches(docs.sparkSession)
    counts = stored(counted(docs, possible(docs, least, cells), cells), "terms-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = stored(kept, "terms-kept")
    own = stored(counts.drop("docs").join(kept, ["lang", "term"]), "terms-own")
    discard(counts)
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("t"))
    zero = lambda *names: {c: F.coalesce(c, F.lit(0).cast("long")) for c in names}
    groups = stored(_read(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).join(totals, ["lang", "source"], "left"), "terms-groups")
    langs = stored(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(langs, "lang", "left"), "terms-langs")
    groups = hot_join(groups, langs, ["lang"], "n_sources").withColumns(zero("total", "t", "n_terms", "lang_total"))
    groups = stored(groups.withColumns({"g": F.monotonically_increasing_id(), "p0": share("0", "total", "n_terms")}), "terms-groups")
    small = groups.select("lang", "source", "g", F.col("total").alias("group_total"), "t", "n_terms", "lang_total", "p0")
    rows = hot_join(own, small, ["lang", "source"], "t")
    rows = stored(rows.select("g", "lang", "source", "term", share("n", "group_total", "n_terms").alias("p"), share("total", "lang_total", "n_terms").alias("q"), "p0"), "terms-rows")
    discard(kept, own)

    side = lambda end, *more: groups.select("lang", F.col("source").alias(f"source_{end}"), F.col("g").alias(end), F.col("p0").alias(f"z{end}"), F.col("t").alias(f"t{end}"), *more)
    salted = side("a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    others = side("b", "n_terms").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = stored(salted.join(others, ["lang", "salt"]).where("a < b").drop("salt"), "terms-pairs")
    sums = stored(pairs.join(_pair_sums(rows, pairs), ["a", "b"], "left").select("lang", "source_a", "source_b", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "terms-sums")
    ends = [sums.select("lang", F.col(f"source_{x}").alias("source"), F.lit("pair").alias("part"), F.col(f"source_{y}").alias("item"), "value") for x, y in ("ab", "ba")]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = reduce(DataFrame.unionByName, ends).withColumn("rank", F.row_number().over(order))
    more = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ("p", "q").alias("value"))
    first = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(first)
