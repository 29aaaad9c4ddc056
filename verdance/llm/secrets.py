"""Secret scans with SQL functions only: fixed patterns, and a battery of randomness tests.

Base kinds are found by pattern. Beside them, every run of 20 or more characters of the usual
encodings is a candidate. Its encoding is inferred from the characters it has, and three tests look
at it: a chi-squared test of a uniform alphabet, a Wald-Wolfowitz runs test about the middle of the
alphabet, and a serial correlation test of neighbours. The null hypothesis is text: symbols as uneven
as TEXT_EXCESS says for the encoding, so that the chi-squared statistic is noncentral with a
noncentrality that grows with the length; its p is the chance that text looks as uniform (the cube root
of the statistic is all but normal). The p of the other two is the chance that neighbours without
dependence, which text has at best, look as independent. The three are combined by Fisher's sum of
their logarithms, the latter two with weight 1/4 each, as they tell less; and a candidate whose runs or
neighbours chance doesn't give (two-sided, level ALPHA) isn't random, however uniform it is.
Benjamini-Hochberg control at level FDR then runs over all candidates of the corpus, by encoding and
length class, since short candidates can tell less and are far more numerous. p-values are binned, so
the counts that the control needs are a small table whatever the input.

Defined cases: a null text counts as empty; an empty text has no spans; equal texts have equal
spans; positions are in code points, end exclusive; a candidate that overlaps a base span is left
to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Fixed patterns of the base kinds, in the order in which equal starts are listed: kind, pattern,
#: the group whose length counts, and its least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RANDOM = "random"
#: Alphabets from narrow to wide; a candidate has the first that holds all its characters.
ENCODINGS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hexupper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("lowernum", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("alpha", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: Text in an encoding: the sum of squared shares of English letters, and the shares of capitals among letters of both
#: cases, of digits, and of one separator, where the alphabet has them.
LETTERS, CAPITALS, DIGITS, SEPARATORS = 0.0655, 1 / 6, 0.1, 1 / 7
#: Digits and hexadecimal digits have no letter statistics; their text is taken to be this uneven.
NUMERIC_EXCESS = 1.2


def _text_excess(alphabet: str) -> float:
    """Excess of text over a uniform alphabet: the sum of squared shares times the alphabet's size, less 1."""
    upper, lower = "Z" in alphabet, "z" in alphabet
    if not upper and not lower:
        return NUMERIC_EXCESS
    n_digits = sum(c.isdigit() for c in alphabet)
    digits = DIGITS if n_digits else 0.0
    separators = SEPARATORS if "/" in alphabet or "_" in alphabet else 0.0
    cases = CAPITALS**2 + (1 - CAPITALS) ** 2 if upper and lower else 1.0
    squares = (1 - digits - separators) ** 2 * LETTERS * cases + digits**2 / max(1, n_digits) + separators**2
    return len(alphabet) * squares - 1


#: Of each encoding, 0.70 (lower) to 2.20 (any).
TEXT_EXCESS = {name: _text_excess(alphabet) for name, alphabet in ENCODINGS}
ALPHA, FDR = 0.01, 0.05
#: p-values are binned by their logarithm; the last bin holds all that are smaller.
BINS_PER_DECADE, LAST_BIN = 10, 400


#: Items of a fold that are appended to one array.
PART = 256
SPANS = "array<struct<start:int,end:int,token:string,size:int>>"
FREE = "array<struct<start:int,end:int,token:string>>"


def _folded(items: Column, kind: str, state: Column, step) -> Column:
    """The items of type `kind` (an array type) that step(state, item) -> (state, new item or null) makes of an array, in order.

    They are made in parts of PART items, so that no long array is copied for each of them."""

    def one(acc: Column, i: Column) -> Column:
        made = lambda m: F.struct(m["state"].alias("state"), F.when(m["item"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(m["item"]))).alias("out"))
        return let(let(step(acc["state"], i), lambda m: F.struct(m["state"].alias("state"), m["item"].alias("item"))), made)

    def over(all_: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            inside = F.slice(all_, k * PART + 1, F.lit(PART))
            seed = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out"))
            return let(F.aggregate(inside, seed, one), lambda m: F.struct(m["state"].alias("state"), F.concat(acc["parts"], F.array(m["out"])).alias("parts")))

        last = F.floor((F.size(all_) - 1) / PART).cast("int")
        seed = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("parts"))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), last), seed, part)["parts"])).otherwise(F.array().cast(kind))

    return let(items, over)


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, token, size) of the leftmost non-overlapping matches whose group is long enough.

    A match starts after the gaps and the matches before it; texts without a match are passed over once."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.transform(F.arrays_zip(found.alias("found"), counted.alias("counted"), gaps.alias("gaps")), lambda x: F.struct(x["found"].alias("token"), x["counted"].alias("size"), x["gaps"].alias("gap")))

    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        end = start + F.length(x["token"])
        item = F.when(x["size"] >= least, F.struct(start.alias("start"), end.alias("end"), x["token"].alias("token"), x["size"].alias("size")))
        return F.struct(end.alias("state"), item.alias("item"))

    matches = F.filter(rows, lambda x: x["token"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), _folded(matches, SPANS, F.lit(0), step)).otherwise(F.array().cast(SPANS))


def _free(base: Column, candidates: Column) -> Column:
    """The candidates that no base span overlaps, by one walk over both in order of start.

    A candidate waits for what comes next: base spans that began before it are known by their greatest end, and one that
    begins within it comes before the next candidate."""
    spans = lambda x, rank: F.transform(x, lambda s: F.struct(s["start"].alias("start"), (s["rank"] if rank is None else F.lit(rank)).alias("rank"), s["end"].alias("end"), (F.lit(None).cast("string") if rank is None else s["token"]).alias("token")))
    close = F.array(F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(0).alias("rank"), F.lit((1 << 31) - 1).alias("end"), F.lit(None).cast("string").alias("token")))
    walk = F.array_sort(F.concat(spans(base, None), spans(candidates, len(BASE)), close))
    waiting = "struct<start:int,end:int,token:string>"

    def step(state: Column, x: Column) -> Column:
        token = x["token"].isNotNull()
        held = F.when(token & (state["end"] <= x["start"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token")))
        end = F.when(token, state["end"]).otherwise(F.greatest(state["end"], x["end"]))
        done = F.when(state["held"].isNotNull() & (token | (x["start"] >= state["held"]["end"])), state["held"])
        return F.struct(F.struct(end.alias("end"), held.alias("held")).alias("state"), done.alias("item"))

    return _folded(walk, FREE, F.struct(F.lit(0).alias("end"), F.lit(None).cast(waiting).alias("held")), step)


def _normal_below(z: Column) -> Column:
    """Standard normal distribution function (a rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


def _combined(p: Column, *minor: Column) -> Column:
    """The chance that -2 ln p - (ln of both minor) / 2 is as large if all three are uniform.

    The sum of an exponential variable of rate a and two of rate b: the closed form of its upper tail."""
    least = lambda x: F.log(F.greatest(x, F.lit(1e-300)))
    total = -2 * least(p) - sum((least(m) for m in minor), F.lit(0.0)) / 2
    a, b = 0.5, 2.0
    d = b - a
    return let(total, lambda t: F.least(F.lit(1.0), F.exp(-b * t) * (1 + b * t) + (b / d) ** 2 * (F.exp(-a * t) - F.exp(-b * t) * (1 + d * t))))


def _codes(core: Column, alphabet: str) -> Column:
    return F.transform(F.split(core, ""), lambda c: F.instr(F.lit(alphabet), c))


def tested(token: Column) -> Column:
    """A struct of encoding, length_class and bin (of p) of a candidate."""
    two_sided = lambda z: 2 * (1 - _normal_below(F.abs(z)))

    def encoded(core: Column) -> Column:
        out = None
        for name, alphabet in reversed(ENCODINGS):
            item = F.struct(F.lit(name).alias("encoding"), F.lit(float(len(alphabet))).alias("k"), F.lit(TEXT_EXCESS[name]).alias("excess"), _codes(core, alphabet).alias("codes"))
            out = item if out is None else F.when(F.translate(core, alphabet, "") == "", item).otherwise(out)
        return let(out, counted)

    def counted(x: Column) -> Column:
        codes = F.filter(x["codes"], lambda c: c > 0)
        return let(F.struct(x["encoding"].alias("encoding"), x["k"].alias("k"), x["excess"].alias("excess"), (x["k"] / 2 + 0.5).alias("middle"), codes.alias("codes"), F.size(codes).cast("double").alias("n")), measured)

    def measured(x: Column) -> Column:
        high = lambda c: c > x["middle"]
        from_middle = lambda c: c.cast("double") - x["middle"]
        squares = F.aggregate(F.array_distinct(x["codes"]), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x["codes"], lambda d: d == c)).cast("double"), F.lit(2.0)))
        walk = F.aggregate(
            F.slice(x["codes"], F.lit(2), F.size(x["codes"]) - 1),
            F.struct(F.get(x["codes"], F.lit(0)).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("lagged")),
            lambda acc, c: F.struct(c.alias("last"), (acc["runs"] + F.when(high(c) != high(acc["last"]), 1.0).otherwise(0.0)).alias("runs"), (acc["lagged"] + from_middle(c) * from_middle(acc["last"])).alias("lagged")),
        )
        stats = F.struct(x["encoding"].alias("encoding"), x["k"].alias("k"), x["excess"].alias("excess"), x["n"].alias("n"), (x["k"] * squares / x["n"] - x["n"]).alias("chi"), F.size(F.filter(x["codes"], high)).cast("double").alias("above"), walk.alias("walk"))
        return let(stats, judged)

    def judged(x: Column) -> Column:
        n, k, above = x["n"], x["k"], x["above"]
        expected = 2 * above * (n - above) / n + 1
        spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        runs_z = (x["walk"]["runs"] - expected) / F.sqrt(spread)
        serial_z = x["walk"]["lagged"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        shift = (n - 1) * x["excess"]
        mean = k - 1 + shift
        spread_root = 2 * (1 + shift / mean) / (9 * mean)
        text_z = (F.cbrt(F.greatest(x["chi"], F.lit(0.0)) / mean) - 1 + spread_root) / F.sqrt(spread_root)
        within = lambda z, step: 1 - two_sided(F.abs(z) + step / 2)  # noqa: E731  with all of the step that z is on
        chance = (expected > 2.5) & (two_sided(runs_z) >= ALPHA) & (two_sided(serial_z) >= ALPHA)
        p = F.when(chance, _combined(_normal_below(text_z), within(runs_z, 1 / F.sqrt(spread)), within(serial_z, 12 / ((k * k - 1) * F.sqrt(n - 1))))).otherwise(1.0)
        bin_ = F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE)
        return F.struct(x["encoding"].alias("encoding"), F.least(F.floor(F.log2(n / 5)), F.lit(8)).cast("int").alias("length_class"), F.greatest(F.lit(0), F.least(bin_, F.lit(LAST_BIN))).cast("int").alias("bin"))

    return let(F.regexp_replace(token, "=+$", ""), encoded)


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, rank, end, kind), free candidates (array of start, end and their test x), n_assign, n_access and n_hex of every row.

    Each text is looked through once, and each candidate tested once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = lambda t: F.struct(*(_spans(t, pattern, group, least).alias(kind) for kind, pattern, group, least in BASE), _spans(t, CANDIDATE, 0, 20).alias("c"))

    def sorted_(x: Column) -> Column:
        base = F.array_sort(F.concat(*(_ranked(x[kind], rank, kind) for rank, (kind, *_) in enumerate(BASE))))
        return F.struct(base.alias("base"), x["c"].alias("c"), *(F.size(x[kind]).cast("long").alias(f"n_{kind}") for kind, *_ in BASE))

    def freed(x: Column) -> Column:
        free = F.transform(_free(x["base"], x["c"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s["token"]).alias("x")))
        return F.struct(x["base"].alias("base"), free.alias("free"), *(x[f"n_{kind}"].alias(f"n_{kind}") for kind, *_ in BASE))

    return docs.select("doc_id", let(let(let(text, found), sorted_), freed).alias("s")).select("doc_id", "s.*")


def discoveries(found: DataFrame) -> dict[tuple[str, int], int]:
    """For each encoding and length class of the candidates of scored(), the lowest bin of p that the control accepts.

    Benjamini-Hochberg on bins: with n candidates and r of them at a bin or beyond, the bin is
    accepted if its largest p is at most FDR * r / n. The counts are a table of at most
    len(ENCODINGS) * 9 * (LAST_BIN + 1) rows, whatever the input."""
    rows = found.select(F.explode("free.x").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows:
        counts.setdefault((r["x"]["encoding"], r["x"]["length_class"]), {})[r["x"]["bin"]] = r["n"]
    accepted: dict[tuple[str, int], int] = {}
    for key, bins in counts.items():
        total, beyond = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            beyond += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) <= FDR * beyond / total:
                accepted[key] = b
    return accepted


def scan(docs: DataFrame, accepted: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind), n_assign, n_access and n_hex of every row of docs.

    accepted: bins as discoveries() returns them; found from docs itself where not given."""
    found = stored(scored(docs), "secrets")
    accepted = discoveries(found) if accepted is None else accepted

    def passes(x: Column) -> Column:
        least = F.lit(LAST_BIN + 1)
        for (encoding, length_class), b in sorted(accepted.items()):
            least = F.when((x["encoding"] == encoding) & (x["length_class"] == length_class), b).otherwise(least)
        return x["bin"] >= least

    more = _ranked(F.filter("free", lambda s: passes(s["x"])), len(BASE), RANDOM)
    return found.withColumn("spans", F.array_sort(F.concat("base", more))).drop("free")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    d = scan(docs)
    return d.select("doc_id", *(f"n_{kind}" for kind, *_ in BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
