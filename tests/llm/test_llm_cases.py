"""Cases of the operators that are easily missed: no labels, one id in all rows, several blocks, clashing names."""

import random

from pyspark.sql import functions as F

from verdance.llm import common, decontaminate, linededup, neardup, quality


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.score_documents(docs, quality.fit(docs, one)).collect())


def test_samples_of_one_id(spark):
    df = spark.range(3000).select(F.lit(5).alias("id"), (F.col("id") % 2).cast("string").alias("text"))
    assert common.bounded_sample(df, ["id", "text"], 200).count() == 200
    assert common.bounded_sample(df.limit(100), ["id", "text"], 200).count() == 100


def test_benchmark_in_several_blocks(spark, monkeypatch):
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(30))) for k in range(6)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(9, "nothing of these")], "doc_id long, text string")
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 60)
    assert len(list(decontaminate._blocks(bench))) > 1
    assert sorted((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()) == [(k, k) for k, _ in items]
    assert [x["doc_id"] for x in decontaminate.remove(docs, bench).collect()] == [9]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y"), (2, "a b", "x", "z")], "doc_id long, text string, __vd_id string, __vd_node string")
    assert linededup.clean(df).columns == df.columns and linededup.clean(df).count() == 2
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and [r["__vd_node"] for r in kept.collect()] == ["y"]


def test_frequent_shingles_alone_bound_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 0)
    words = [f"w{i}" for i in range(39)]
    groups = neardup.Groups(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:32])), (3, " ".join(words[:20]))], "doc_id long, text string"))
    groups.members = groups.nodes.select("node", F.lit(1).cast("long").alias("bucket"), F.lit(3).cast("long").alias("n"))
    pairs = groups.crossing(spark.createDataFrame([], "node binary, label binary"))
    assert pairs.count() == 1 and groups.verified(pairs).count() == 1  # 35 and 28 shingles; 16 are too few for either
