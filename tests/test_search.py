"""The search index against plain Python, its increments, and texts that are easily missed."""

import math
import random
import re

import pytest

from verdance.sources import search

SCHEMA = "study_id string, title string, text string"


def expected(rows, queries, k, need):
    docs = {}
    for i, title, text in rows:
        body = "\n".join(x for x in (title, text) if x is not None)
        if i is not None:
            docs[i] = min(docs.get(i, body), body)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: words(t) for i, t in docs.items()}
    n, mean = len(bags), sum(map(len, bags.values())) / max(1, len(bags))
    df = {}
    for w in bags.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        terms = set(words(text))
        found = []
        for i, w in bags.items():
            met = terms & set(w)
            if met and (need == "any" or met == terms):
                parts = [math.floor(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) * 1e6) for t in met]
                found.append((-sum(parts), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    vocabulary = ["the", "Heart", "heart", "failure", "Größe", "naïve", "x2", "type-2", "日本", *(f"w{k}" for k in range(60))]
    out = [(f"NCT{k:08d}", " ".join(r.choices(vocabulary, k=3)), "the " + " ".join(r.choices(vocabulary, k=r.randint(0, 80)))) for k in range(150)]
    return [*out, (None, "the", "heart"), ("NCT90000000", None, None), ("NCT90000001", "", "!!! ..."), out[3], ("NCT90000002", "heart", "failure " * 20_000), ("NCT90000003", "w1 w2", "w3"), ("NCT90000004", "w1 w2", "w3")]


QUERIES = [(1, "heart failure"), (2, "THE the w1"), (3, ""), (4, None), (5, "unknownword w2"), (6, "größe 日本"), (7, "w1 w2 w3 w4 w5 the"), (8, "type 2")]


@pytest.mark.parametrize("need", ["any", "all"])
def test_against_plain_python(spark, tmp_path, rows, need):
    index = search.Index(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(rows[:60], SCHEMA), "study_id", "title", "text")
    index.add(spark.createDataFrame(rows, SCHEMA), "study_id", "title", "text")
    index.add(spark.createDataFrame(rows, SCHEMA), "study_id", "title", "text")  # adds nothing
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert index.studies().count() == len({i for i, *_ in rows if i})
    got = index.search_all(asked, 7, need)
    assert sorted(map(tuple, got.collect())) == expected(rows, QUERIES, 7, need)
    whole = index.compact(f"file://{tmp_path}/whole")
    assert len(whole.segments()) == 1
    one = whole.search("Heart, failure!", 5, need)
    assert [(1, *r) for r in map(tuple, one.collect())] == expected(rows, QUERIES[:1], 5, need)


def test_a_segment_that_was_broken_off_is_not_read(spark, tmp_path, rows, monkeypatch):
    index = search.Index(spark, f"file://{tmp_path}/index")
    studies = spark.createDataFrame(rows[:20], SCHEMA)
    index.add(studies, "study_id", "title", "text")
    before = sorted(map(tuple, index.search("the", 50).collect()))
    spark.createDataFrame([("the", "NCT00000001", 99, 99)], "term string, study_id string, tf long, length long").write.parquet(f"file://{tmp_path}/index/postings/unfinished")
    assert sorted(map(tuple, index.search("the", 50).collect())) == before


def test_empty_index_and_scan(spark, tmp_path):
    index = search.Index(spark, f"file://{tmp_path}/index")
    assert index.search("anything").collect() == []
    index.add(spark.createDataFrame([], SCHEMA))
    assert index.search("anything", need="any").collect() == []
    with pytest.raises(ValueError, match="any or all"):
        index.search("x", need="some")
    index.add(spark.createDataFrame([("NCT00000001", "t", "some words")], SCHEMA))
    plan = index.search("words")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,words)" in plan or "In(term, [words])" in plan


def test_a_posting_is_shuffled_once(spark, tmp_path):
    """Postings were multiplied by the queries that have their term before they were dealt out by study."""
    index = search.Index(spark, f"file://{tmp_path}/once")
    index.add(spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", None)], "study_id string, text string"))
    assert sorted((r["study_id"], r["length"]) for r in index.studies().collect()) == [("a", 2), ("b", 1), ("c", 0)]
    asked = spark.createDataFrame([(i, "x y") for i in range(3)], "query_id int, text string")
    got = index.search_all(asked, 2)
    assert sorted((r["query_id"], r["rank"], r["study_id"]) for r in got.collect()) == [(i, k, s) for i in range(3) for k, s in ((1, "a"), (2, "b"))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(study_id#" in plan and "hashpartitioning(query_id#" in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, study_id", plan)
