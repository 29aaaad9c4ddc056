"""Sentences that occur often: each is looked at once, with the results of looking at every one."""

import pytest
from pyspark.sql import functions as F

from verdance.functions import logic
from verdance.operators import generation, segmentation
from verdance.plans import stages
from verdance.plans.stages import written

BODY = "diagnosis of asthma\nshort\nsigned informed consent\nhistory of stroke or diagnosis of gout\nnothing that maps\nExclusion criteria: diagnosis of asthma"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(f"NCT{i:08d}", BODY if i % 3 else BODY + f"\ndiagnosis of gout\nAge {18 + i % 4} years or older") for i in range(40)]
    return written(spark.createDataFrame(rows, "study_id string, text string"), "texts")


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_atoms_of_different_sentences(texts):
    one, every = written(segmentation.with_atoms(segmentation.alike(segmentation.sentences(texts))), "atoms"), segmentation.atoms(texts)
    assert one.count() == 11 and one.agg(F.sum("n")).collect()[0][0] == every.count() > 200
    counts = lambda found: table(segmentation.yield_counts(found), "kind", "name", "n")
    assert counts(one) == counts(every)
    pool = lambda found: table(segmentation.distinct_atoms(found), "key", "study_id", "pos", "section", "sentence", "n")
    assert pool(one) == pool(every)
    dates = texts.select("study_id", F.lit("2024-01-01").alias("first_posted"))
    summary = lambda found: segmentation.pool_summary(found, segmentation.distinct_atoms(found), dates).collect()
    assert summary(one) == summary(every)
    with pytest.raises(ValueError, match="single sentences"):
        segmentation.distinct_atoms(one, 2)


def test_corpus_of_different_sentences(texts):
    one, every = written(segmentation.with_forms(segmentation.alike(segmentation.sentences(texts))), "forms"), segmentation.mapped(texts)
    made = lambda rows: table(segmentation.criteria(rows, None), "criterion_id", "polarity", "text", "depth")
    assert made(one) == made(every)
    counts = lambda rows: table(segmentation.corpus_counts(rows, segmentation.corpus(rows, None), None), "kind", "name", "n")
    assert counts(one) == counts(every)
    capped = lambda kept: table(segmentation.criteria_of(kept), "criterion_id", "polarity", "text", "depth")
    for cap in (1, 2, 4):
        assert capped(segmentation.corpus_of(texts, cap)) == capped(segmentation.corpus(every, cap))
    with pytest.raises(ValueError, match="single sentences"):
        segmentation.corpus(one)


def test_forms_of_every_sentence(texts):
    rendered = logic.render(F.col("form.tree"))
    got = segmentation.each_sentence(*segmentation.sentences_with_forms(texts, {"r": rendered}), "r")
    want = segmentation.mapped(texts).where("form IS NOT NULL").withColumn("r", rendered)
    assert table(got, "study_id", "pos", "section", "r") == table(want, "study_id", "pos", "section", "r")


def test_a_small_file_is_many_tasks(spark, tmp_path):
    """A file of few bytes was one task for all its studies."""
    spark.range(0, 12_000, 1, 1).write.parquet(f"file://{tmp_path}/small")
    small = spark.read.parquet(f"file://{tmp_path}/small")
    assert small.rdd.getNumPartitions() < 3
    assert stages.spread(small).rdd.getNumPartitions() == 3
    assert stages.spread(small).distinct().count() == 12_000
    assert stages.spread(small.limit(0)).count() == 0


def test_generated_items_are_cut_without_ranking_them(spark):
    """Whole items were ranked in one task for each level and outcome."""
    pool = [logic.atom(f"f{i}", "measurement", ("ge", i)) for i in range(20)]
    made = generation.depth_ladder(spark, pool, [1], 4)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["gold"] for r in made.collect()) == [False, False, True, True]
