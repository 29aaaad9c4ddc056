"""Running sums, ranks, neighbours and interval joins against plain Python."""

import random
from bisect import bisect_right

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdance.operators import ordered, scoring, trend


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(4)
    seen = {(r.choice(["a", "b", None]), r.choice([None, *[round(r.gauss(0, 3), 2) for _ in range(5)]])) for _ in range(3000)}
    return [(g, v, r.randint(0, 5)) for g, v in seen]


@pytest.mark.parametrize("falling", [False, True])
def test_running_sums(spark, values, falling):
    df = spark.createDataFrame(values, "g string, v double, n long")
    got = {(r["g"], r["v"]): r["s"] for r in ordered.running_sums(df, ["g"], "v", {"s": "n"}, falling).collect()}
    assert len(got) == len(values)
    place = lambda v: (v is not None) if falling is False else (v is None)  # noqa: E731  nulls first, or last
    for g in ("a", "b", None):
        own = sorted((x for x in values if x[0] == g), key=lambda x: (place(x[1]), (x[1] or 0) * (-1 if falling else 1)))
        total = 0
        for _, v, n in own:
            total += n
            assert got[(g, v)] == total


def test_average_ranks_and_previous(spark, values):
    rows = [(v, k) for k, (_, v, _) in enumerate(values)] + [(1.5, 9000 + k) for k in range(2000)]
    got = {r["k"]: r["rank"] for r in ordered.average_ranks(spark.createDataFrame(rows, "v double, k long"), "v", "rank").collect()}
    want = pd.Series({k: v for v, k in rows if v is not None}).rank()
    assert got == want.to_dict()
    distinct = sorted({v for v, _ in rows if v is not None})
    before = ordered.with_previous(spark.createDataFrame([(v, f"x{v}") for v in distinct], "v double, s string"), "v", "s", "p").collect()
    assert {r["v"]: r["p"] for r in before} == dict(zip(distinct, [None, *(f"x{v}" for v in distinct)]))
    assert ordered.average_ranks(spark.createDataFrame([], "v double, k long"), "v", "rank").collect() == []


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_overlapping_intervals(spark, ranges):
    r = random.Random(ranges)
    rows = [(k, x := round(r.random(), 2), x + r.choice([0, 0.01, 0.1, 0.9])) for k in range(300)] + [(900, None, 1.0), (901, 0.5, None), (902, 0.9, 0.1), (903, 0.0, 5.0), (904, 0.5, 0.5), (905, 0.5, 0.5)]
    got = sorted(map(tuple, ordered.overlapping(spark.createDataFrame(rows, "k long, lo double, hi double"), "k", "lo", "hi", ranges).collect()))
    sound = [x for x in rows if x[1] is not None and x[2] is not None and x[1] <= x[2]]
    assert got == sorted((a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])


def test_more_levels_than_all_pairs_take(spark, monkeypatch):
    monkeypatch.setattr(trend, "MOST_PAIRED", 20)
    table = spark.createDataFrame([(float(k), 40, (k * 7) % 41) for k in range(41)], "x double, n long, k long")
    with pytest.raises(ValueError, match="overlapping_levels"):
        trend.level_pairs(table)
    got = {(r["x_a"], r["x_b"]): r["n_needed"] for r in trend.overlapping_levels(table).collect()}
    monkeypatch.setattr(trend, "MOST_PAIRED", 100)
    assert got == {(r["x_a"], r["x_b"]): r["n_needed"] for r in trend.level_pairs(table).where("overlap").collect()}


def test_selective_accuracy_with_a_null_group_and_ties(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", None]), r.choice([0.1, 0.5, 0.9, 0.95]), r.random() < 0.7) for _ in range(500)]
    df = spark.createDataFrame(rows, "grp string, confidence double, ok boolean").select("*", F.lit(True).alias("gold"), F.col("ok").alias("predicted"))
    got = {(x["grp"], x["coverage"]): (x["k"], round(x["accuracy"], 9)) for x in scoring.selective_accuracy(df, "grp").collect()}
    for g in ("x", None):
        own = [x for x in rows if x[0] == g]
        for c in range(10, 101, 10):
            k, sum_, left = max(1, round(len(own) * c / 100)), 0.0, 0
            left = k
            for conf in (0.95, 0.9, 0.5, 0.1):
                tied = [x[2] for x in own if x[1] == conf]
                take = min(left, len(tied))
                sum_ += take * sum(tied) / max(1, len(tied))
                left -= take
            assert got[(g, c)] == (k, round(sum_ / k, 9))
    assert len(scoring.selective_accuracy(df).collect()) == 10


def test_pairs_are_not_joined_with_their_levels(spark):
    """Pairs, of which there are many more than levels, were joined with the levels twice."""
    table = spark.createDataFrame([(float(k), 40, (k * 7) % 41) for k in range(41)], "x double, n long, k long")
    assert trend.overlapping_levels(table)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("n", [0, 1, 2, 7, 45])
def test_position_among_bounds(spark, n):
    """The step was taken for the index that transform() gives a second parameter, so every position was 0."""
    bounds = [k / 10 for k in range(n)]
    values = [v / 20 for v in range(-3, 2 * n + 3)]
    column = F.array(*map(F.lit, bounds)).cast("array<double>")
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered._position(column, n, F.col("v")).alias("at")).collect()
    assert {r["v"]: r["at"] for r in got} == {v: bisect_right(bounds, v) for v in values}


def test_pairs_are_dealt_to_tasks(spark):
    """All intervals fell into one range, so one task made all pairs."""
    df = spark.createDataFrame([(k, k / 400, k / 400 + 0.4) for k in range(400)], "k long, lo double, hi double")
    tasks = ordered.overlapping(df, "k", "lo", "hi", 40).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert max(r["count"] for r in tasks) < sum(r["count"] for r in tasks) / 4
