"""Runs, gates, sources, generated sets and the smaller operators, on inputs checked by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from verdance.functions import logic, text
from verdance.operators import agreement, errors, generation, runs, sampling, scoring, segmentation, trend, validation
from verdance.sources import studies, tables

PER_ITEM = "run string, model string, prompt string, item_id string, level int, gold boolean, predicted boolean, confidence double, rationale string, unanswerable boolean, abstain boolean"


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("aged ٣٠ years or older",), ("history of stroke within ٦ months",), ("aged ٣٠ to ۴۰ years",)], "s string")
    got = [r[0] for r in df.select(logic.render(text.sentence_atom(F.col("s"))["tree"])).collect()]
    assert got == ["age >= 30.0 years", "stroke (within the past 6.0 months)", "age between 30.0 and 40.0 years"]


def per_item(spark):
    rows = [("a", "m", "2", f"i{k}", k % 2, True, k > 2, 0.5 if k else 0.9, "same" if k < 3 else "other", k == 0, k == 1) for k in range(6)]
    return spark.createDataFrame(rows + [("b", "m", "2", "j", None, True, True, 1.0, None, True, None), ("b", "m", "2", "k", 1, None, True, 1.0, None, True, None)], PER_ITEM)


def test_summaries_and_gates(spark):
    got = {r["run"]: r.asDict() for r in runs.summaries(per_item(spark)).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["n_correct"], a["n_errors"], a["accuracy"], a["n_abstain"], a["usable_confidence"]) == (6, 3, 3, 0.5, 1, True)
    assert (a["distinct_error_rationales"], a["n_errors_with_rationale"], a["n_unanswerable_errors"], a["mean_confidence"]) == (1, 3, 1, 0.5667)
    assert (b["n"], b["accuracy"], b["n_errors"], b["distinct_error_rationales"], b["n_unanswerable_errors"], b["has_rationales"]) == (1, 1.0, 0, None, None, False)
    gates = {tuple(r) for r in runs.gates(runs.summaries(per_item(spark))).collect()}
    assert gates == {("a", "repeated_rationales", "BLOCK"), ("a", "unanswerable_errors", "BLOCK"), ("b", "constant_confidence", "BLOCK"), ("b", "perfect_score", "NOTE")}
    levels = {(r["run"], r["level"]): (r["n"], r["n_correct"]) for r in runs.run_levels(per_item(spark)).collect()}
    assert levels == {("a", 0): (3, 1), ("a", 1): (3, 2)}
    assert runs.summaries(per_item(spark).limit(0)).collect() == []


def test_other_gates(spark):
    table = lambda rows: spark.createDataFrame(rows, "x double, n long, k long")
    falling = {tuple(r)[:3] for r in runs.sweep_gates(table([(1.0, 400, 380), (2.0, 400, 300), (3.0, 400, 200), (4.0, 400, 100)])).collect()}
    assert falling == {("sweep", "attainable_p", "NOTE")}
    rising = {tuple(r)[:3] for r in runs.sweep_gates(table([(1.0, 20, 10), (2.0, 20, 11)])).collect()}
    assert rising == {("sweep", "not_monotone", "BLOCK"), ("sweep", "no_significant_trend", "BLOCK"), ("sweep", "attainable_p", "NOTE"), ("1.0-2.0", "indistinguishable_levels", "NOTE")}
    assert trend.depth_trend(table([(1.0, 20, 10), (2.0, 20, 10)])).collect()[0]["monotone"]
    assert [tuple(r) for r in runs.mixed_gates(table([(1.0, 20, 10), (2.0, 20, 11)])).collect()] == [("mixed", "no_separated_pair", "NOTE")]
    assert runs.mixed_gates(table([(1.0, 400, 380), (2.0, 400, 100)])).collect() == []
    corpus = lambda rows: {r["gate"] for r in runs.corpus_gates(spark.createDataFrame(rows, "polarity string, depth int")).collect()}
    assert corpus([("inclusion", 0)]) == {"no_coordination", "no_exclusion"} and corpus([("exclusion", 1)]) == set()
    with pytest.raises(ValueError):
        trend.level_pairs(spark.range(1001).select(F.col("id").cast("double").alias("x"), F.lit(2).alias("n"), F.lit(1).alias("k")))


def test_settings_and_provenance(spark):
    df = per_item(spark)
    assert runs.one_setting(df) is df
    with pytest.raises(ValueError, match="2 settings"):
        runs.one_setting(df.withColumn("prompt", F.col("run"))).collect()
    assert tuple(runs.provenance(df, "run", "prompt").collect()[0]) == (["a", "b"], ["2"])


def test_levels_are_rounded(spark):
    node = [tuple(n.values()) for n in logic.group("or", logic.atom("a"), logic.atom("b", "observation"), logic.atom("c"))]
    two = [tuple(n.values()) for n in logic.group("or", logic.atom("a"), logic.atom("b"))]
    facts = {"a": (True, None, None, False)}
    df = spark.createDataFrame([(node, facts, True, True), (node, facts, True, False), (two, facts, False, False)], f"tree {logic.TREE}, facts {logic.FACTS}, gold boolean, predicted boolean")
    r = runs.by_level(df, logic.depth(F.col("tree"))).collect()[0]
    assert (r["n"], r["leaves_mean"], r["leaves_min"], r["leaves_max"], r["undocumented_mean"], r["currency_ambiguous_mean"], r["gold_met_rate"], r["accuracy"], r["balanced_accuracy"]) == (3, 2.7, 2, 3, 1.7, 1.0, 0.667, 0.667, 0.75)
    t = runs.structure_trend(df, "leaves", 50).collect()[0]
    assert (t["n"], t["n_correct"], t["depth_size_r"]) == (3, 2, 0.0)


def test_generated_sets(spark):
    pool = [logic.atom(f"f{i}", "measurement", ("ge", i) if i % 2 else None) for i in range(60)]
    made = generation.size_sweep(spark, pool, [7, 28], 6)
    s = [(r["level"], r["s"]) for r in made.select("level", logic.structure(F.col("tree")).alias("s")).collect()]
    assert len(s) == 12 and all((x["leaves"], x["depth"], x["canonical_depth"]) == (level, 3, 3) for level, x in s)
    ladder = generation.depth_ladder(spark, pool, [1, 3], 4)
    assert sorted((r["level"], r["gold"]) for r in ladder.collect()) == [(d, g) for d in (1, 3) for g in (False, False, True, True)]
    assert all(r["level"] == r["d"] for r in ladder.select("level", logic.depth(F.col("tree")).alias("d")).collect())
    with pytest.raises(ValueError, match="too few attempts"):
        generation.half_met(generation.items(spark, {2: lambda p, rng: generation.matched(2, p, rng)}, pool, 2), 40)


def test_sample_of_one_id(spark):
    rows = spark.range(3000).select(F.lit(5).alias("k"), F.lit("hot").alias("s"))
    assert sampling.stratified(rows, ["s"], "k", 50).count() == 50


def test_pool_and_corpus(spark, tmp_path):
    body = "diagnosis of asthma\ndiagnosis of stroke\ndiagnosis of gout"
    texts = spark.createDataFrame([("NCT00000001", body), ("NCT00000002", "diagnosis of gout\ndiagnosis of lupus")], "study_id string, text string")
    pool = segmentation.distinct_atoms(segmentation.atoms(texts))
    assert sorted((r["study_id"], r["pos"], r["n"]) for r in pool.collect()) == [("NCT00000001", 0, 1), ("NCT00000001", 1, 1), ("NCT00000001", 2, 2), ("NCT00000002", 1, 1)]
    capped = segmentation.distinct_atoms(segmentation.atoms(texts), 1)
    assert sorted((r["study_id"], r["pos"]) for r in capped.collect()) == [("NCT00000001", 0), ("NCT00000002", 0)]
    rows = segmentation.mapped(texts)
    assert [r["criterion_id"] for r in segmentation.criteria(rows, limit=2).orderBy("criterion_id").collect()] == ["ctgov:NCT00000001:inc:00", "ctgov:NCT00000001:inc:01"]
    assert tuple(segmentation.mapping_rate(segmentation.corpus_counts(rows, segmentation.corpus(rows))).collect()[0]) == (5, 4, 0.8)
    assert {r["polarity"]: r["n"] for r in segmentation.histogram(segmentation.criteria(rows), F.col("polarity"), "polarity").collect()} == {"inclusion": 4}
    digest = studies.write_pool(pool, f"file://{tmp_path}/pool")
    again = studies.read_pool(spark, f"file://{tmp_path}/pool")
    assert again.count() == 4 and studies.pool_digest(again.repartition(3)).collect()[0]["digest"] == digest != studies.pool_digest(capped).collect()[0]["digest"]
    capped.limit(0).write.parquet(f"file://{tmp_path}/empty")
    with pytest.raises(ValueError):
        studies.read_pool(spark, f"file://{tmp_path}/empty")


def test_cache_and_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([("NCT00000001", "a", "2026-01-02"), ("NCT00000001", "a", "2026-01-02"), ("../evil", "b", "2026-01-01")], "study_id string, text string, first_posted string")
    for _ in range(2):
        studies.write_cache(rows, path)
    cached = spark.read.parquet(path)
    assert [r["study_id"] for r in cached.collect()] == ["NCT00000001"]
    assert studies.one_study(cached, "NCT00000001").count() == 1
    with pytest.raises(ValueError):
        studies.one_study(cached, "NCT1")
    query = studies.StudyQuery(phases=("PHASE3",), posted_from="2026-01-01")
    studies.write_manifest(studies.manifest(cached, query, "s1"), f"file://{tmp_path}/manifest")
    m = studies.read_manifest(spark, f"file://{tmp_path}/manifest").collect()[0]
    assert (m["n_studies_cached"], m["snapshot_id"], m["first_posted_from"], m["query_params"]["posted_from"]) == (1, "s1", "2026-01-02", "2026-01-01")


def test_submissions(spark, tmp_path):
    good = {"model": "m", "task": "t", "predictions": [{"item_id": "a", "label": True, "confidence": 0.5}, {"item_id": "b", "label": False}]}

    def read(name, content):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "s.json").write_text(content)
        return sorted(tuple(r) for r in tables.read_submission(spark, f"file://{folder}").collect())

    assert read("good", json.dumps(good)) == [("m", "t", "a", True, 0.5), ("m", "t", "b", False, 1.0)]
    for name, content in {"list": "[1]", "broken": "{", "no_task": json.dumps(good | {"task": None}), "kinds": json.dumps(good | {"predictions": [{"item_id": "a", "label": "maybe"}]}), "text": json.dumps(good | {"predictions": "x"})}.items():
        with pytest.raises(Exception):
            read(name, content)
    tables.write_submission(spark.createDataFrame([("b", True, 0.5), ("a", False, 0.1)], "item_id string, label boolean, confidence double"), "m", "t", f"file://{tmp_path}/out")
    lines = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [[p["item_id"] for p in json.loads(x)["predictions"]] for x in lines] == [["a", "b"]]


def test_coverage_of_submissions(spark):
    items = spark.createDataFrame([("a", True), ("b", False)], "item_id string, gold boolean")
    one = spark.createDataFrame([("a", True)], "item_id string, predicted boolean")
    with pytest.raises(ValueError, match="1 missing"):
        scoring.covered(items, one)
    assert scoring.covered(items.where("gold"), one).count() == 1
    replayed = runs.replay(spark.createDataFrame([("a", True, None)], "item_id string, label boolean, confidence double"))
    assert [tuple(r) for r in replayed(items).collect()] == [("a", True, 1.0, None)]


def test_results_and_verdicts(spark, tmp_path):
    run = {"task": "t", "model": {"name": "m", "prompt_version": "2"}, "per_item_predictions": [{"item_id": "a", "depth": 2, "gold": "met", "predicted": "unmet", "confidence": 0.5}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.json").write_text(json.dumps(run))
    (tmp_path / "sub" / "leaderboard.json").write_text(json.dumps(run))
    assert [tuple(r) for r in tables.read_results(spark, f"file://{tmp_path}/sub").select("run", "model", "item_id", "level", "gold", "predicted").collect()] == [("t::m@sub", "m", "a", 2, True, False)]
    (tmp_path / "v.csv").write_text("﻿item_id,verdict\na,Keep\nb,drop\nc,\nd,maybe\n")
    assert sorted(tuple(r) for r in tables.read_verdicts(spark, f"file://{tmp_path}/v.csv").collect()) == [("a", "keep"), ("b", "drop")]
    shown = tables.report(spark.createDataFrame([(1, 0.5), (2, None)], "n int, v double"))
    assert shown == "| n | v |\n|---|---|\n| 1 | 0.5000 |\n| 2 | - |"


def test_checks(spark):
    stored = spark.createDataFrame([("a", True), ("b", False)], "item_id string, gold boolean")
    found = spark.createDataFrame([("a", True), ("b", True)], "item_id string, gold boolean")
    assert [r["item_id"] for r in validation.gold_mismatches(stored, found).collect()] == ["b"]
    bad = [tuple(n.values()) for n in logic.atom(" ", "condition", ("between", 5, 3))]
    trees = spark.createDataFrame([("x", bad), ("y", [tuple(n.values()) for n in logic.atom("a")])], f"id string, tree {logic.TREE}")
    assert sorted(tuple(r) for r in validation.rejected_trees(trees, "id", F.col("tree")).collect()) == [("x", "between_not_rising"), ("x", "blank_entity"), ("x", "number_on_other_type")]
    claim = spark.createDataFrame([("accuracy .5 and accuracy 0.75",)], "t string").select(validation.figures(F.col("t"), r"accuracy ([0-9.]+)").alias("v")).collect()[0]["v"]
    assert claim == [0.5, 0.75]
    three = spark.createDataFrame([("i", "fabrication"), ("j", "none")], "item_id string, category string")
    machine = spark.createDataFrame([("i", "none"), ("j", "none")], "item_id string, category string")
    r = agreement.third_signal(three, machine).collect()[0]
    assert (r["n"], r["agreement"], r["n_impossible"]) == (2, 0.5, 1)
    both = spark.createDataFrame([("temporal", 3, 1), ("temporal", 1, 0), ("none", 4, 0)], "category string, n_scored long, n_withheld long")
    assert {r["category"]: (r["n"], r["share"]) for r in errors.pooled(both).collect()} == {"temporal": (4, 0.5), "none": (4, 0.5)}


def test_streams(spark, tmp_path):
    from verdance.streaming import events

    rows = [("2024-01-01 01:00:00", 1, 7, "view", 1.0), ("2024-01-01 01:00:00", 1, 7, "view", 1.0), ("2024-01-01 02:00:00", 2, 7, "view", 2.0)]
    spark.createDataFrame(rows, "t string, event_id long, user_id long, event_type string, value double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "event_id", "user_id", "event_type", "value").write.parquet(f"file://{tmp_path}/ev")

    def ran(make, name, mode):
        stream = spark.readStream.schema("ts timestamp, event_id long, user_id long, event_type string, value double").parquet(f"file://{tmp_path}/ev")
        make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["event_id"] for r in ran(lambda s: events.once(s, "event_id"), "once_", "append")) == [1, 2]
    assert [(r["user_id"], r["entity"], r["value"]) for r in ran(events.facts_by_window, "facts_", "complete")] == [(7, "view", 2.0)]


def test_pairs_that_cannot_be_told_apart_say_what_it_takes(spark):
    table = spark.createDataFrame([(1.0, 60, 48), (2.0, 60, 41), (3.0, 60, 10)], "x double, n long, k long")
    got = {r["subject"]: r["n_needed"] for r in runs.sweep_gates(table).collect() if r["gate"] == "indistinguishable_levels"}
    a, b = 48 / 60, 41 / 60
    root = 1.959963984540054 * math.sqrt((a + b) * (1 - (a + b) / 2)) + 0.8416212335729143 * math.sqrt(a * (1 - a) + b * (1 - b))
    assert got == {"1.0-2.0": math.ceil((root / (a - b)) ** 2)}


def test_adjudication_sheet(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "=none", "temporal", True, "annotator1_governs", 3), ("i2", "none", "numeric_threshold", False, "resolve_on_merits", None)], "item_id string, a string, b string, clinical boolean, rule string, depth int")
    path = f"file://{tmp_path}/sheet"
    tables.write_adjudication(rows, path)
    sheet = tables.read_sheet(spark, path, tables.ADJUDICATION)
    assert sheet.columns == tables.ADJUDICATION
    assert {tuple(r) for r in sheet.select("item_id", "depth", "annotator1", "clinical_judgement_required").collect()} == {("i1", "3", "=none", "yes"), ("i2", None, "none", "no")}
    filled = sheet.withColumns({"resolved_category": F.when(F.col("item_id") == "i1", " Temporal"), "resolution_note": F.lit(" clear ")})
    tables.write_sheet(filled, path + "-filled")
    assert [tuple(r) for r in tables.read_adjudication(spark, path + "-filled").collect()] == [("i1", "temporal", "clear")]
    tables.write_sheet(filled.withColumn("resolved_category", F.lit("guess")), path + "-wrong")
    with pytest.raises(Exception, match="unknown category guess"):
        tables.read_adjudication(spark, path + "-wrong").collect()


def test_results_are_written_as_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_ROWS", 20)
    rows = spark.createDataFrame([("deep", "m1" if k % 2 else "m/2", "2", f"i{k}", k % 3, k % 2 == 0, k % 3 == 0, k / 100, None if k == 5 else "why", k == 7) for k in range(100)], "task string, model string, prompt string, item_id string, level int, gold boolean, predicted boolean, confidence double, rationale string, unanswerable boolean")
    tables.write_results(rows, f"file://{tmp_path}/results")
    back = tables.read_results(spark, f"file://{tmp_path}/results")
    same = lambda df: sorted(map(tuple, df.select("model", "prompt", "item_id", "level", "gold", "predicted", "confidence", "rationale", "unanswerable").collect()), key=repr)
    assert same(back) == same(rows)
    assert back.select("run").distinct().count() == 2
    tables.write_report({"first": rows.limit(2), "second": rows.limit(0)}, f"file://{tmp_path}/out")
    assert "## first" in "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/out/report").collect())
    assert spark.read.json(f"file://{tmp_path}/out/first").count() == 2


def test_pool_summary_of_nothing(spark):
    found = segmentation.atoms(spark.createDataFrame([], "study_id string, text string"))
    one = segmentation.pool_summary(found, segmentation.distinct_atoms(found), spark.createDataFrame([], "study_id string, first_posted string")).collect()[0]
    assert (one["n_atoms"], one["n_studies"], one["considered"], one["match_rate"], one["first_posted_from"]) == (0, 0, 0, None, None)
