"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of hashes of its lines that aren't blank. A window is a run of
consecutive lines that holds RUN_WORDS words and would not without its first, or without its last,
line. Each window selects its least line hash as fingerprint, so any two places that share a run of
RUN_WORDS words select a common fingerprint within it. Only selected positions are stored, each with
the few lines around it that its windows can reach, and joined: a fingerprint that only one place has
ends there. Each of the others is extended both ways to the windows that select it, which are compared
by the hashes of all their lines. A run's first place is the least (doc_id, text hash, line); at every
later place the windows that matched are deleted. Neighbouring positions' windows overlap, so a match
goes on from position to position in both directions and the union is the whole repeated run.

Places meet through the least place of their group, found by an aggregation, so no pairs are made
within a group, and frequent lines go by broadcast (hot_join).

Defined cases: a null text stays null, an empty one empty; a document of fewer than RUN_WORDS words
never changes; rows with equal id and text are one place and change alike; a null id comes first;
blank lines within a deleted run go with it; white space within a line counts as one blank, at its
ends not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_join, let, stored, unused

RUN_WORDS = 50
KEY = ["id", "h1", "h2"]
RUNS = "array<struct<first:int,last:int>>"
#: Words of 64 bits of the Bloom filter of the texts that have a run to delete: 2 MB, whatever the input.
WORDS = 1 << 18


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _lines(text: Column) -> Column:
    """Array of (i, h, w): number, hash and words of each line that isn't blank."""
    plain = F.split(F.regexp_replace(text, "[ \\t\\r\\f\\x0B\\u00A0]+", " "), "\n")
    trimmed = F.filter(F.transform(plain, lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("l"))), lambda x: x["l"] != "")
    words = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.transform(trimmed, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["l"]).alias("h"), words(x["l"]).alias("w")))


def _reach(words: Column, run_words: int, short: Column | None = None) -> Column:
    """How many leading elements of words hold run_words together; if all don't, 0, or else what is given as short."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    step = lambda a, w: F.when(a["sum"] >= run_words, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n")))
    return F.aggregate(words, zero, step, lambda a: F.when(a["sum"] >= run_words, a["n"]).otherwise(F.lit(0) if short is None else short))


# A line has a word at least, so a window has run_words lines at most.
def _after(words: Column, p: Column, run_words: int) -> Column:
    return F.slice(words, p, F.lit(run_words))


def _until(words: Column, p: Column, run_words: int) -> Column:
    """From element p backwards."""
    return F.reverse(F.slice(words, F.greatest(p - run_words + 1, F.lit(1)), F.least(p, F.lit(run_words))))


def _windows(words: Column, run_words: int) -> Column:
    """Array of (p, n): the first line, from 1, and the number of lines of each window."""
    ahead = F.transform(words, lambda _, i: _reach(_after(words, i + 1, run_words), run_words))
    behind = F.transform(words, lambda _, i: _reach(_until(words, i + 1, run_words), run_words))

    def spans(n: Column) -> Column:
        from_first = F.transform(n["ahead"], lambda k, i: F.struct((i + 1).alias("p"), k.alias("n")))
        from_last = F.transform(n["behind"], lambda k, i: F.struct((i + 2 - k).alias("p"), k.alias("n")))
        other = F.filter(from_last, lambda s: (s["n"] > 0) & (F.get(n["ahead"], s["p"] - 1) != s["n"]))  # else it is the window from its first line
        return F.concat(F.filter(from_first, lambda s: s["n"] > 0), other)

    return let(F.struct(ahead.alias("ahead"), behind.alias("behind")), spans)


def _selected(hashes: Column, window: Column) -> Column:
    """Which line, from 1, a window selects: the first of those with its least hash."""
    return let(F.slice(hashes, window["p"], window["n"]), lambda h: (window["p"] - 1 + F.array_position(h, F.array_min(h))).cast("int"))


def positions(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows (id, h1, h2, fp, line, at, i, h, w) of the fingerprints of each text: hash, number of the line, and the lines that
    windows around it can reach, as numbers, hashes and words, with the fingerprint as element `at`."""
    d = docs.select(*_key(F.col("doc_id"), F.col("text")), _lines(F.col("text")).alias("a"))
    d = d.select(*KEY, F.col("a.i").alias("i"), F.col("a.h").alias("h"), F.col("a.w").alias("w"))
    i, h, w = F.col("i"), F.col("h"), F.col("w")

    def around(at: Column) -> Column:
        before = _reach(F.when(at > 1, _until(w, at - 1, run_words)).otherwise(F.array().cast("array<int>")), run_words, F.least(at - 1, F.lit(run_words)))
        after = _reach(_after(w, at + 1, run_words), run_words, F.size(w) - at)
        part = lambda x, n: F.slice(x, at - n["before"], n["before"] + 1 + n["after"])
        return let(F.struct(before.alias("before"), after.alias("after")), lambda n: F.struct(
            F.element_at(h, at).alias("fp"), F.element_at(i, at).alias("line"), (n["before"] + 1).alias("at"), part(i, n).alias("i"), part(h, n).alias("h"), part(w, n).alias("w")))

    # Only the part around a fingerprint leaves the text's row, so rows stay in proportion to its lines.
    chosen = F.array_distinct(F.transform(_windows(w, run_words), lambda s: _selected(h, s)))
    return d.select(*KEY, F.explode(F.transform(chosen, around)).alias("f")).select(*KEY, "f.*")


def extended(matched: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows (id, h1, h2, first, last, content): positions extended both ways to all windows that select them."""
    at, h = F.col("at"), F.col("h")
    mine = F.filter(_windows(F.col("w"), run_words), lambda s: (s["p"] <= at) & (s["p"] + s["n"] > at) & (_selected(h, s) == at))
    window = lambda s: F.struct(
        F.element_at("i", s["p"]).alias("first"), F.element_at("i", s["p"] + s["n"] - 1).alias("last"), F.xxhash64(F.slice(h, s["p"], s["n"]), s["n"]).alias("content"))
    return matched.select(*KEY, F.explode(F.transform(mine, window)).alias("s")).select(*KEY, "s.*")


def repeated(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows (id, h1, h2, runs): the later repeated runs of lines of each place, as a sorted array of disjoint (first, last)."""
    found = stored(positions(docs, run_words), "line-prints")
    place = lambda line: F.struct(*KEY, line)
    prints = found.groupBy("fp").agg(F.min(place("line")).alias("a"), F.max(place("line")).alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("fp", "n")
    near = stored(extended(hot_join(found, prints, ["fp"], "n", "left_semi"), run_words), "line-matches")
    discard(found)
    origin = near.groupBy("content").agg(F.min(place("first")).alias("origin"), F.max(place("first")).alias("b"), F.count(F.lit(1)).alias("n")).where("origin < b").select("content", "origin", "n")
    later = hot_join(near, origin, ["content"], "n").where(place("first") > F.col("origin")).select(*KEY, "first", "last").distinct()
    # Overlapping and adjoining windows are one run.
    by = Window.partitionBy(*KEY).orderBy("first", "last")
    until = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = later.withColumn("new", F.when(F.col("first") <= until + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.groupBy(*KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    out = stored(run.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-runs")
    discard(near)
    return out


def _with_runs(docs: DataFrame, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """rows, made of docs, with the disjoint runs to delete from each in a new column, and that column's name."""
    names = {c: unused(docs, c) for c in (*KEY, "r", "r1", "r2", "runs")}
    keyed = rows.withColumns(dict(zip((names[c] for c in KEY), _key(F.col("doc_id"), F.col("text")))))
    found = found.select(F.col("id").alias(names["r"]), F.col("h1").alias(names["r1"]), F.col("h2").alias(names["r2"]), F.col("runs").alias(names["runs"]))
    same = (F.col(names["h1"]) == F.col(names["r1"])) & (F.col(names["h2"]) == F.col(names["r2"])) & F.col(names["id"]).eqNullSafe(F.col(names["r"]))
    return keyed.join(found, same, "left").drop(*(names[c] for c in (*KEY, "r", "r1", "r2"))), names["runs"]


def deletions(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and deleted (`first-last` line numbers from 0, comma-joined) of every row of docs."""
    rows = docs.select("doc_id", "text", F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    d, runs = _with_runs(docs, rows, repeated(docs, run_words))
    n = F.coalesce(F.aggregate(runs, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    text = F.array_join(F.transform(F.coalesce(F.col(runs), F.array().cast(RUNS)), lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return d.select("doc_id", "n_lines", n.alias("n_deleted"), text.alias("deleted"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines that are in none of the runs: what lies before, between and after them."""
    def part(k: Column) -> Column:
        start = F.coalesce(F.get(runs, k - 1)["last"] + 1, F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(runs, k)["first"], F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part))


def _word(h1: Column) -> Column:
    return F.pmod(h1, F.lit(WORDS))


def _mask(h2: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h2, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def _apart(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that may have a run of `found`, and those that have none and can stay where they are."""
    word, mask, bits = (unused(docs, c) for c in ("word", "mask", "bits"))
    filled = found.select(_word(F.col("h1")).alias(word), _mask(F.col("h2")).alias("m")).groupBy(word).agg(F.bit_or("m").alias(bits))
    _, h1, h2 = _key(F.col("doc_id"), F.col("text"))
    seen = docs.withColumns({word: _word(h1), mask: _mask(h2)}).join(F.broadcast(filled), word, "left")
    may = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return seen.where(may).select(*docs.columns), seen.where(~may).select(*docs.columns)


def clean(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the later repeated runs deleted from text, and n_chars (if there) set to the new length; all other columns stay.

    A document of which nothing but blank lines is left has only repeated others, and goes. Only texts that have a run, as far as
    a Bloom filter can tell, are shuffled to meet it."""
    found = repeated(docs, run_words)
    some, others = _apart(docs, found)
    d, runs = _with_runs(docs, some, found)
    left, changed = unused(docs, "left"), F.col(runs).isNotNull()
    d = d.withColumn(left, F.when(changed, F.array_join(let(F.split("text", "\n"), lambda lines: _without(lines, F.col(runs))), "\n")))
    d = d.where(~changed | (F.trim(F.col(left)) != ""))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(changed, F.length(left)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.withColumn("text", F.when(changed, F.col(left)).otherwise(F.col("text"))).select(*docs.columns).unionByName(others)
