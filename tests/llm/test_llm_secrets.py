"""Random spans of the secret scan against plain p-values, texts with thousands of them, and cases easily missed."""

import random
import string
import time

import brute
import pytest

from verdance.llm import secrets

AL = string.ascii_letters + string.digits
SCHEMA = "doc_id long, text string, base string, free int, spans string, x long"


def token(r):
    body = lambda a, n: "".join(r.choice(a) for _ in range(n))
    n = r.randint(5, 70)
    return r.choice([
        "password=" + body(AL, n), "AKIA" + body(string.ascii_uppercase + string.digits, n), body("0123456789abcdef", n), body(AL, n), body(string.ascii_lowercase, n), body(string.digits, n),
        "token: " + body(AL, n) + "/" + body(AL, n), "some/long_path/of_words/that-goes/on/and_on", "internationalizationofficers", "é" + body(AL + "+/", n) + "==", "plain words of text",
    ])


def test_all_spans_against_plain_p_values(spark):
    r = random.Random(8)
    rows = [(k, r.choice([" ", "\n", ", ", ""]).join(token(r) for _ in range(r.randint(0, 30)))) for k in range(250)] + [(900, None), (901, ""), (902, "=" * 5000)]
    got = secrets.span_digests(spark.createDataFrame([(*x, "b", 1, "s", 2) for x in rows], SCHEMA)).collect()
    want = brute.all_spans(rows, secrets.ENCODINGS, secrets.TEXT_EXCESS)
    assert {x["doc_id"]: x["spans"] for x in got} == want
    assert sum(s.count("random") for s in want.values()) > 50
    assert {x["doc_id"]: x["base_sha256"] for x in got} == {i: brute.sha(brute.listed(brute.base_spans(t))) for i, t in rows}


def test_one_text_with_thousands_of_keys(spark):
    r = random.Random(1)
    body = lambda n: "".join(r.choice(AL) for _ in range(n))
    text = " ".join(f"token={body(20)} {body(32)}" for _ in range(4000))
    began = time.time()
    got = secrets.span_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert time.time() - began < 60  # a walk over pairs would take hours
    assert got["n_assign"] == 4000 and got["spans"].count("random") > 3000


def test_empty_table_repeated_rows_and_no_spans(spark):
    assert secrets.span_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "secret=abcdef1"), (1, "secret=abcdef1"), (None, "secret=abcdef1"), (2, "nothing")]
    got = sorted(((x["doc_id"], x["n_assign"], x["spans"]) for x in secrets.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 1, "assign:0:14"), (1, 1, "assign:0:14"), (None, 1, "assign:0:14"), (2, 0, "")], key=repr)


@pytest.mark.parametrize("text", ["token=aaaaaaaaaaaaaaaaaaaaaaaaaaaa/bbbbbbbbbbb", "x" * 25 + "password=" + "y" * 30, "AKIA" + "B" * 20 + "cccccccccccccccccccccc", "0123456789abcdef01234567deadbeefghijklmnop", "a" * 30 + " secret=" + "b" * 10 + " " + "c" * 30])
def test_a_candidate_that_touches_a_base_span_is_left_to_it(spark, text):
    free = secrets.scored(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["free"]
    base = brute.base_spans(text)
    assert [(f["start"], f["end"]) for f in free] == [(m.start(), m.end()) for m in brute.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
