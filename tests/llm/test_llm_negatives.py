"""Hard negatives against plain Python, and the bounds of the rotated space."""

import math
import random

import numpy as np
import pytest

from verdance.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, id string, v int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows):
    sound = []
    for n, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    last = lambda i: math.inf if i is None else i
    out = []
    for n, a, label, u in sound:
        if a is None or a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(u, v)), last(i), m, i, other) for m, i, other, v in sound if m != n), key=lambda x: x[:3])
        for s, _, _, p, _ in [x for x in scored if x[4] == label][:5]:
            fit = [x for x in scored if x[4] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, x[3], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(seed, n, width):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(10)]
    return [(k, [c + r.gauss(0, 0.25) for c in centre[k % 10]], r.randrange(10) if k % 3 else k % 10) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    some = vectors(1, 420, 16)
    same = some[100]
    odd = [(501, None, 1), (502, [], 1), (503, [0.5, None], 2), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, 1), (506, [0.25] * 20, None), (None, some[3][1], 3), (None, some[50][1], 4), (507, [0.5] * 3, 4), (508, [0.1] * 20, 5)]
    return [*some, *[(600 + k, same[1], (same[2] + k % 2) % 10) for k in range(120)], some[100], some[100], some[7], *odd]


@pytest.mark.parametrize("anchors", [1 << 14, 4])
def test_against_plain_python(spark, rows, monkeypatch, anchors):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    df = spark.createDataFrame([(*x, 1, "i", 2) for x in rows], SCHEMA).repartition(5)
    got = negatives.mine(df)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, [0.5], 1, 1, "i", 1), (50, None, 1, 1, "i", 1)], SCHEMA)
    assert negatives.mine(none).collect() == []


def test_bounds_spare_products_and_lose_none():
    r = np.random.default_rng(5)
    v = (r.normal(0, 1, (3000, 64)) * np.linspace(40, 1, 64)).astype(np.int64)
    axes = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    ids, label = np.arange(3000), np.zeros(3000, np.int64)
    anchors = negatives.Side(ids[:20], ids[:20], label[:20], v[:20], axes)
    best, verified = negatives.Best(20, 5), 0
    band = np.full((20, 1), negatives.FLOOR), np.full((20, 1), np.iinfo(np.int64).max)
    for k in range(0, 3000, 500):
        at = slice(k, k + 500)
        verified += negatives.compare(anchors, *band, True, negatives.Side(ids[at], ids[at], label[at], v[at], axes), best)
    assert verified < 0.4 * 20 * 3000
    for q in range(20):
        scores = v @ v[q]
        want = sorted(((-int(scores[j]), j) for j in range(3000) if j != q))[:5]
        assert [(-s, i) for s, i in want] == [(int(s), int(i)) for s, i in zip(best.score[best.query == q], best.id[best.query == q])]
    with pytest.raises(ValueError, match="too large"):
        huge = negatives.Side(ids[:1], ids[:1], label[:1], np.full((1, 64), 2**40), axes)
        negatives.compare(huge, band[0][:1], band[1][:1], True, huge, negatives.Best(1, 5))
