"""The divergence audit against plain Python with whole numbers, and its sketch."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from verdance.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, term string, g long, n int"


def expected(rows, least=10, top=10):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(TERM.findall(lower(t)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x for _, x, _ in docs}:
        own = [(w, s) for w, x, s in docs if x == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for _, s in own}
        for w, s in own:
            counts[s].update(t for t in w if df[t] >= least)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, o.decode(), -v, k + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, o) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["alpha", "Beta", "naïve", "ÉTÉ", "été", "日本", "x1y", "under_score", "it's", "tab\tline\nend", *(f"w{chr(97 + k)}" for k in range(26)), *(f"rare{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(26))]
    out = [(" ".join(r.choice(words[: 10 + 30 * (k % 3)] if k % 4 else words) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None]), r.choice(["s1", "S2", "ß", None, "s10"])) for k in range(400)]
    return [*out, (None, "en", "s1"), ("", "", ""), ("nothing kept here", "fr", "a"), (None, "fr", "b"), ("alpha " * 50_000, "en", "s1"), *[out[0]] * 30, ("alpha", "en", "only"), ("... 123", "en", "none")]


def test_against_plain_python(spark, rows):
    docs = spark.createDataFrame([(1, t, x, s, "t", 1, 2) for t, x, s in rows], DOCS)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_a_full_sketch_changes_nothing(spark, rows):
    docs = spark.createDataFrame([(1, t, x, s, "t", 1, 2) for t, x, s in rows[:200]], DOCS)
    assert sorted(map(tuple, divergence.audit(docs, least=3, top=2, cells=64).collect())) == expected(rows[:200], 3, 2)


def test_sketch_never_underestimates(spark, rows):
    docs = spark.createDataFrame([(1, t, x, s, "t", 1, 2) for t, x, s in rows], DOCS).repartition(5)
    every = divergence.counted(docs, np.full(divergence.ROWS * 64 // 64, -1), 64).groupBy("lang", "term").sum("docs").collect()
    some = {(r["lang"], r["term"]) for r in divergence.counted(docs, divergence.possible(docs, 10, 1 << 16), 1 << 16).collect()}
    must = {(r["lang"], r["term"]) for r in every if r["sum(docs)"] >= 10}
    assert must <= some and len(some) < len(every)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
