"""Scores, trends, agreement, sampling, generation, sources on inputs small enough to check by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.functions import cells, logic
from verdance.functions.intervals import sample_size, wilson
from verdance.operators import agreement, errors, generation, runs, sampling, scoring, trend, validation
from verdance.sources import studies, tables


def decisions(spark, rows):
    return spark.createDataFrame(rows, "gold boolean, predicted boolean, confidence double, grp string")


def test_wilson(spark):
    df = spark.createDataFrame([(36, 60), (60, 60), (0, 60), (0, 0)], "k long, n long").select(wilson(F.col("k"), F.col("n")).alias("w")).select("w.*")
    (a, b, c, d) = [tuple(r) for r in df.collect()]
    assert a == pytest.approx((0.4737, 0.7143), abs=1e-3)
    assert b[1] == 1 and c[0] == 0 and d == (0, 0)


def test_sample_size(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.8, 0.6), (0.0, 1.0)], "a double, b double")
    p = 0.7
    want = math.ceil((1.959963984540054 * math.sqrt(2 * p * (1 - p)) + 0.8416212335729143 * math.sqrt(0.16 + 0.24)) ** 2 / 0.04)
    assert [r[0] for r in df.select(sample_size(F.col("a"), F.col("b"))).collect()][:2] == [-1, want]


def test_scores(spark):
    df = decisions(spark, [(True, True, 0.9, "x"), (True, False, 0.5, "x"), (False, True, 0.5, None), (None, True, 0.1, "x")])
    h = scoring.headline(df).collect()[0]
    assert (h["n"], h["accuracy"], h["balanced_accuracy"]) == (3, pytest.approx(1 / 3), 0.25)
    f1 = {r["label"]: r["f1"] for r in scoring.class_scores(df).collect()}
    assert f1 == {"true": 0.5, "false": 0.0}
    assert {r["grp"]: r["n"] for r in scoring.group_scores(df, "grp").collect()} == {"x": 2, "ungrouped": 1, "overall": 3}
    assert scoring.headline(df.limit(0)).collect()[0]["accuracy"] == 0


def test_calibration(spark):
    rng = np.random.default_rng(1)
    rows = [(bool(g), bool(p), float(c), "x") for g, p, c in zip(rng.integers(0, 2, 500), rng.integers(0, 2, 500), rng.integers(0, 101, 500) / 100)]
    want = 0.0
    for b in range(10):
        inside = [r for r in rows if b / 10 < r[2] <= (b + 1) / 10 or (b == 0 and r[2] == 0)]
        want += abs(sum(r[0] == r[1] for r in inside) - sum(r[2] for r in inside)) / len(rows)
    assert scoring.calibration(decisions(spark, rows)).collect()[0]["ece"] == pytest.approx(want)


def test_selective_accuracy(spark):
    flat = [(True, i < 6, 0.7, "x") for i in range(10)]
    out = {r["coverage"]: r["accuracy"] for r in scoring.selective_accuracy(decisions(spark, flat), "grp").collect()}
    assert len(out) == 10 and all(v == pytest.approx(0.6) for v in out.values())
    two = [(True, True, 0.9, "x")] * 2 + [(True, False, 0.5, "x")] * 2
    out = {r["coverage"]: r["accuracy"] for r in scoring.selective_accuracy(decisions(spark, two), "grp").collect()}
    assert (out[50], out[100]) == (1.0, 0.5)


def levels(spark, rows):
    return spark.createDataFrame(rows, "x double, n long, k long")


def test_rank_trend(spark):
    acc = [0.95, 0.95, 0.867, 0.717, 0.60]
    t = trend.permutation_test(levels(spark, [(float(i + 2), 1000, round(a * 1000)) for i, a in enumerate(acc)])).collect()[0]
    assert (t["rho"], t["p_one_sided"], t["min_attainable_p"]) == pytest.approx((-0.9747, 1 / 60, 1 / 120), abs=1e-4)
    many = trend.permutation_test(levels(spark, [(float(i), 10, 10 - i % 3) for i in range(9)]), replicates=200).collect()[0]
    assert many["mode"] == "monte_carlo" and 0 < many["p_one_sided"] <= 1
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 7.0)], "a double, b double")
    assert trend.spearman(df, "a", "b").collect()[0]["rho"] == pytest.approx(0.8660254)
    assert trend.pearson(df.withColumn("c", F.lit(1.0)), "a", "c").collect()[0]["r"] == 0


def test_logistic(spark):
    t = trend.item_trend(levels(spark, [(0.0, 10, 8), (1.0, 10, 4)]), replicates=300).collect()[0]
    logit = lambda p: math.log(p / (1 - p))
    assert t["slope"] == pytest.approx(logit(0.4) - logit(0.8))
    assert t["se"] == pytest.approx(math.sqrt(1 / 8 + 1 / 2 + 1 / 4 + 1 / 6))
    assert 0 < t["p_permutation"] < 0.3
    assert trend.item_trend(levels(spark, [(0.0, 5, 5), (1.0, 5, 5)])).collect()[0]["degenerate"]
    assert trend.power([1.0, 2.0, 3.0], [200] * 3, [0.9, 0.6, 0.3], 40, spark).collect()[0]["significant"] == 40
    assert [len(trend.level_pairs(levels(spark, [(1.0, 60, 36), (2.0, 60, 50), (3.0, 60, 20)])).collect())] == [3]


def test_agreement(spark):
    a, b = list("xxyyzzxy"), list("xyyyzxxx")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(zip(a, b))], "item_id int, a string, b string")
    po = sum(x == y for x, y in zip(a, b)) / 8
    pe = sum(a.count(c) * b.count(c) for c in "xyz") / 64
    k = agreement.kappa(df).collect()[0]
    assert (k["n"], k["agreement"], k["kappa"]) == (8, pytest.approx(po), pytest.approx((po - pe) / (1 - pe)))
    assert agreement.kappa(df.select("item_id", F.lit("x").alias("a"), F.lit("x").alias("b"))).collect()[0]["kappa"] is None
    assert agreement.kappa(df.limit(0)).collect()[0]["kappa"] == 0
    each = {r["category"]: (r["n_a"], r["n_b"], r["n_both"]) for r in agreement.per_category(df).collect()}
    assert each == {"x": (3, 4, 2), "y": (3, 3, 2), "z": (2, 1, 1)}
    ci = agreement.kappa_interval(df, replicates=300).collect()[0]
    assert ci["low"] <= ci["kappa"] <= ci["high"]
    gone = agreement.consensus(df, df.limit(0).select("item_id", F.col("a").alias("category")))
    with pytest.raises(Exception, match="no resolved category"):
        gone.collect()


def test_errors(spark):
    tree = logic.group("and", logic.negation(logic.atom("a")), logic.atom("b", "measurement", ("lt", 5)))
    node = [tuple(n.values()) for n in tree]
    fact = lambda v: {"b": (True, v, None, False)}
    df = spark.createDataFrame([(node, fact(1.0), True, False, "r"), (node, fact(9.0), False, True, "r "), (node, fact(1.0), True, True, None)], f"tree {logic.TREE}, facts {logic.FACTS}, gold boolean, predicted boolean, rationale string")
    out = errors.labelled(df)
    assert sorted(r["category"] for r in out.collect()) == ["negation_polarity", "numeric_threshold"]
    assert tuple(errors.evidence(out).collect()[0]) == (2, 0, 1, 2)


def test_oracle_is_right_and_the_blind_reader_errs(spark):
    pool = [logic.atom(f"f{i}", "measurement", ("ge", i) if i % 2 else None, ("current",) if i % 3 == 0 else None) for i in range(30)]
    made = generation.items(spark, {d: (lambda p, rng, d=d: generation.matched(d, p, rng)) for d in (2, 4, 6)}, pool, 12, attempts=6)
    again = generation.items(spark, {d: (lambda p, rng, d=d: generation.matched(d, p, rng)) for d in (2, 4, 6)}, pool, 12, attempts=6).repartition(7)
    key = lambda df: sorted((r[0], r[1], r[2], r[3]) for r in df.select("level", "number", "attempt", logic.key(F.col("tree"))).collect())
    assert key(made) == key(again)
    half = generation.half_met(made, 6).cache()
    assert {(r["level"], r["gold"]): r["count"] for r in half.groupBy("level", "gold").count().collect()} == {(d, g): 3 for d in (2, 4, 6) for g in (True, False)}
    s = [r["s"] for r in half.select(logic.structure(F.col("tree")).alias("s"), "level").collect()]
    assert all((x["leaves"], x["groups"], x["nots"]) == (14, 6, 4) and x["depth"] == x["canonical_depth"] for x in s)
    items = half.select(F.concat_ws("/", "level", "number", "attempt").alias("item_id"), "tree", generation.as_map(F.col("facts")).alias("facts"), "gold")
    scores = {name: scoring.headline(runs.answer_with(items, model)).collect()[0]["accuracy"] for name, model in runs.MODELS.items()}
    assert scores["oracle"] == 1.0 and scores["negation_blind"] < 1.0
    with pytest.raises(ValueError):
        generation.check_shape(1, 14, 6, 4)


def test_paired(spark):
    tree = [tuple(n.values()) for n in logic.atom("a", "measurement", ("ge", 3))]
    df = spark.createDataFrame([("c1", tree), ("c2", tree)], f"criterion_id string, tree {logic.TREE}")
    assert sorted(r["item_id"] for r in generation.paired(df).collect()) == ["real:c1:00", "real:c1:01", "real:c2:00", "real:c2:01"]


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    order = sampling.shuffled_order(F.col("k"), 5)
    want = sorted(r["k"] for r in df.orderBy(order).limit(137).collect())
    assert sorted(r["k"] for r in sampling.least(df, order, 137).collect()) == want
    assert sampling.least(df, order, 5000).count() == 1000
    skewed = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("s"))
    got = sampling.stratified(skewed, ["s"], "k", 50).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"rare": 5, "hot": 45}
    train, test = sampling.split_by_key(df, "s", 0.34)
    assert (test.select("s").distinct().count(), train.count() + test.count(), validation.leaked(train, test, "s").count()) == (1, 1000, 0)


def test_validation(spark):
    p = spark.createDataFrame([("a", True, 0.5), ("a", True, 2.0), (" ", None, None)], "item_id string, label boolean, confidence double")
    assert sorted((r["item_id"], r["reason"]) for r in validation.rejected_predictions(p).collect()) == [(" ", "no_item_id"), (" ", "no_label"), ("a", "confidence_out_of_range"), ("a", "duplicate_item_id")]
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert sorted(map(tuple, validation.coverage(items, p).collect())) == [(" ", "extra"), ("b", "missing")]
    claims = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 1.0)], "name string, claimed double")
    found = spark.createDataFrame([("x", 0.5004), ("y", 0.8)], "name string, value double")
    assert sorted(r["name"] for r in validation.misstated(claims, found, ["name"]).collect()) == ["y", "z"]


def test_cells(spark):
    df = spark.createDataFrame([("=1+1",), ("plain",), ("'=x",), (None,)], "c string")
    assert [r[0] for r in df.select(cells.neutralised(F.col("c"))).collect()] == ["'=1+1", "plain", "'=x", None]
    assert [r[0] for r in df.select(cells.restored(cells.neutralised(F.col("c")))).collect()][:2] == ["=1+1", "plain"]
    raw = spark.createDataFrame([('```json\n{"label": "Met", "confidence": 3, "rationale": "x {y}"}\n```',), ('{"label": 0}',), ("no json",)], "r string")
    out = [tuple(r[0]) for r in raw.select(cells.parsed_answer(F.col("r"))).collect()]
    assert out == [(True, 1.0, "x {y}"), (False, 0.5, None), (None, 0.5, None)]


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        studies.StudyQuery()
    folder = tmp_path / "cache"
    folder.mkdir()
    one = '{"protocolSection": {"identificationModule": {"nctId": "%s"}, "eligibilityModule": {"eligibilityCriteria": "diagnosis of asthma"}}}'
    for name in ("NCT00000001", "NCT00000002"):
        (folder / f"{name}.json").write_text(one % name)
    (folder / "NCT1.json").write_text(one % "NCT1")
    cached = studies.read_cache(spark, f"file://{folder}")
    assert sorted(r["study_id"] for r in cached.collect()) == ["NCT00000001", "NCT00000002"]
    fresh = spark.createDataFrame([("NCT00000002", "t"), ("NCT00000003", "u"), ("../evil", "v")], "study_id string, text string")
    assert [r["study_id"] for r in studies.top_up(cached, fresh).collect()] == ["NCT00000003"]
    assert {r["study_id"]: r["text"] for r in studies.read_through(fresh, cached, fresh).collect()}["NCT00000002"] == "diagnosis of asthma"
    sheet = spark.createDataFrame([("i1", "=cmd", "temporal"), ("i2", 'a "b"\nc', " "), ("i3", "x", "Temporal")], "item_id string, note string, category string")
    tables.write_sheet(sheet, f"file://{tmp_path}/sheet")
    assert {r["item_id"]: r["note"] for r in tables.read_sheet(spark, f"file://{tmp_path}/sheet", ["item_id"]).collect()} == {"i1": "=cmd", "i2": 'a "b"\nc', "i3": "x"}
    assert sorted((r["item_id"], r["category"]) for r in tables.read_annotations(spark, f"file://{tmp_path}/sheet").collect()) == [("i1", "temporal"), ("i3", "temporal")]
    tables.write_submission(spark.createDataFrame([("a", True, 0.5)], "item_id string, label boolean, confidence double"), "m", "t", f"file://{tmp_path}/sub")
    assert tuple(tables.read_submission(spark, f"file://{tmp_path}/sub").collect()[0]) == ("m", "t", "a", True, 0.5)


def test_streaming(spark, tmp_path):
    from verdance.streaming.events import windowed_scores

    spark.createDataFrame([("2024-01-01 01:00:00", True, True), ("2024-01-01 02:00:00", True, False), ("2024-01-02 01:00:00", False, False)], "t string, g boolean, p boolean").selectExpr("CAST(t AS TIMESTAMP) AS ts", "g", "p").write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, g boolean, p boolean").parquet(f"file://{tmp_path}/ev")
    q = windowed_scores(stream, F.col("g"), F.col("p")).writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["n_correct"]) for r in spark.table("scores").collect()) == [(1, 1), (2, 1)]
