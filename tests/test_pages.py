"""Paged scans against a plain walk along the cursor."""

import json
import random

import pytest

from verdance.sources import pages

SCHEMA = "token string, next_token string, records array<int>"


def walked(rows, limit):
    by, token, out, seen = {t: (n, r) for t, n, r in rows if t is not None}, "first", [], set()
    pos = 0
    while token in by and token not in seen and by[token][1] and (limit is None or len(out) < limit):
        seen.add(token)
        following, records = by[token]
        out += [(pos, k, r) for k, r in enumerate(records)]
        token, pos = following, pos + 1
    return out if limit is None else out[:limit]


def chain(n, sizes, end=None):
    names = ["first", *(f"t{k}" for k in range(1, n))]
    return [(t, names[k + 1] if k + 1 < n else end, [k * 100 + j for j in range(sizes[k % len(sizes)])]) for k, t in enumerate(names)]


CASES = {
    "chain": chain(37, [3, 5, 1]),
    "loop": chain(9, [2], end="t4"),
    "gap": chain(6, [4], end="missing"),
    "empty page": [(t, n, [] if t == "t5" else r) for t, n, r in chain(12, [3])],
    "null records": [(t, n, None if t == "t3" else r) for t, n, r in chain(8, [3])],
    "others": [*chain(5, [2]), ("x1", "x2", [7]), ("x2", "t2", [8]), (None, "first", [9])],
    "one": chain(1, [4], end="first"),
    "no first": [("a", "b", [1]), ("b", None, [2])],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_scan(spark, name):
    rows = list(CASES[name])
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for limit in (None, 7):
        assert sorted(map(tuple, pages.scan(df, limit).collect())) == walked(rows, limit), limit


def test_page_files(spark, tmp_path):
    for token, following, records in chain(4, [2]):
        (tmp_path / f"{token}.json").write_text(json.dumps({"studies": [{"id": f"NCT{r:08d}"} for r in records]} | ({"nextPageToken": following} if following else {})))
    got = pages.scan(pages.read_pages(spark, f"file://{tmp_path}", "struct<id:string>"), 5).collect()
    assert sorted((r["pos"], r["record"]["id"]) for r in got) == [(0, "NCT00000000"), (0, "NCT00000001"), (1, "NCT00000100"), (1, "NCT00000101"), (2, "NCT00000200")]
