"""Digest trees, kept answers, quotas filled by rounds, bounded samples of strata."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdance.functions import logic
from verdance.operators import digests, generation, sampling
from verdance.sources import answers


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_root(rows, depth):
    entries = Counter(sha("\u001f".join("\u0000" if v is None else str(v) for v in r)) for r in rows)
    level = {h: (h, n) for h, n in entries.items()}
    for d in range(depth, -1, -1):
        groups = {}
        for key in sorted(level):
            groups.setdefault(key[:d], []).append(level[key])
        level = {p: (sha(",".join(f"{h}:{n}" for h, n in own)), sum(n for _, n in own)) for p, own in groups.items()}
    return sha(f"{level[''][0] if level else sha('')}:{depth}")


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_digest_tree_is_that_of_the_rows(spark, depth):
    r = random.Random(depth)
    rows = [(r.randint(0, 300), r.choice(["a", None, "", "é"])) for _ in range(2000)] + [(7, "a")] * 500
    one = spark.createDataFrame(rows, "k int, v string")
    r.shuffle(rows)
    two = spark.createDataFrame(rows, "k int, v string").repartition(9)
    got = digests.root(one, "k", "v", depth=depth).collect()[0]
    assert (got["n"], got["levels"], got["digest"]) == (2500, depth, expected_root(rows, depth))
    assert digests.root(two, "k", "v", depth=depth).collect()[0] == got
    changed = two.withColumn("v", F.when((F.col("k") == 7) & (F.col("v") == "a"), "b").otherwise(F.col("v")))
    assert digests.root(changed, "k", "v", depth=depth).collect()[0]["digest"] != got["digest"]
    bad = digests.differing(digests.tree(one, "k", "v", depth=depth), digests.tree(changed, "k", "v", depth=depth)).collect()
    assert 1 <= len(bad) <= 2


def test_digest_of_an_empty_table_and_depth(spark):
    empty = digests.root(spark.createDataFrame([], "k int")).collect()[0]
    assert (empty["n"], empty["levels"], empty["digest"]) == (0, 0, expected_root([], 0))
    assert [digests.depth_for(n) for n in (0, 4096, 4097, 4096 * 16, 4096 * 16 + 1)] == [0, 0, 1, 1, 2]


def test_answers_are_asked_once(spark, tmp_path):
    store = answers.AnswerStore(spark, f"file://{tmp_path}/answers")
    items = spark.createDataFrame([(k, f"key{k % 7}", k % 7) for k in range(30)] + [(99, None, 1)], "id int, key string, x int")
    asked = []

    def model(rows):
        asked.append(sorted(r["key"] for r in rows.collect()))
        return rows.select("key", F.when(F.col("x") != 3, F.col("x") * 10).alias("answer"))

    assert store.answers().collect() == []
    assert store.ask(items.where("x < 4"), model) == 4
    assert store.ask(items, model) == 3 and store.ask(items, model) == 0
    assert asked == [[f"key{k}" for k in range(4)], [f"key{k}" for k in range(4, 7)], []]
    got = {r["id"]: (r["answer"], r["has_answer"]) for r in store.answered(items).collect()}
    assert got == {k: (None if k % 7 == 3 else str(k % 7 * 10), True) for k in range(30)} | {99: (None, False)}
    spark.createDataFrame([("key0", "later", "9")], "key string, answer string, segment string").write.mode("append").parquet(store.path)
    assert {r["answer"] for r in store.answered(items.where("x = 0")).collect()} == {"0"}  # the first answer stays


def test_a_run_that_breaks_off_keeps_nothing(spark, tmp_path):
    store = answers.AnswerStore(spark, f"file://{tmp_path}/answers")
    items = spark.createDataFrame([(k, f"key{k}") for k in range(10)], "id int, key string")
    with pytest.raises(Exception, match="broken"):
        store.ask(items, lambda rows: rows.select("key", F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise("x").alias("answer")))
    assert store.answers().count() == 0
    assert store.ask(items, lambda rows: rows.select("key", F.lit("y").alias("answer"))) == 10


POOL = [logic.atom(f"f{i}", "measurement", ("ge", i) if i % 2 else None) for i in range(60)]


def test_rounds_fill_quotas_and_change_nothing(spark, monkeypatch):
    levels = {1: lambda p, rng: logic.group("and", *p[:6]), 2: lambda p, rng: generation.nested(2, p, rng)}
    monkeypatch.setattr(generation, "FIRST", 1)
    few = generation.filled(spark, levels, POOL, 9)
    rows = sorted((r["level"], r["gold"], r["number"], r["k"]) for r in few.withColumn("k", logic.key(F.col("tree"))).select("level", "gold", "number", "k").collect())
    assert Counter((level, gold) for level, gold, *_ in rows) == {(v, g): n for v in (1, 2) for g, n in ((True, 4), (False, 5))}
    monkeypatch.setattr(generation, "FIRST", 40)
    many = generation.filled(spark, levels, POOL, 9)
    assert sorted((r["level"], r["gold"], r["number"], r["k"]) for r in many.withColumn("k", logic.key(F.col("tree"))).select("level", "gold", "number", "k").collect()) == rows


def test_a_level_that_cannot_be_filled_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(generation, "MOST_DRAWS", 20)
    never = logic.group("and", logic.atom("a", "measurement", ("ge", 5.0)), logic.negation(logic.atom("a", "measurement", ("ge", 5.0))))
    with pytest.raises(ValueError, match="can't be filled"):
        generation.filled(spark, {1: lambda p, rng: never}, POOL, 4)


def test_pool_has_an_atom_an_entity(spark):
    trees = [[tuple(n.values()) for n in t] for t in (*POOL, POOL[3], logic.atom("f3", "drug"), logic.group("or", POOL[0], POOL[1]))]
    got = generation.pool_of(spark.createDataFrame([(t,) for t in trees], f"tree {logic.TREE}"))
    assert sorted(t[0]["entity"] for t in got) == sorted(t[0]["entity"] for t in POOL)
    assert len(generation.pool_of(spark.createDataFrame([(t,) for t in trees], f"tree {logic.TREE}"), most=7)) == 7


def test_stratified_takes_the_least_of_each_stratum(spark):
    rows = [(k, "big" if k % 10 else None) for k in range(2000)] + [(5000 + k, "one") for k in range(1)] + [(1, "big")] * 50
    got = sampling.stratified(spark.createDataFrame(rows, "id long, s string"), ["s"], "id", 40).collect()
    order = lambda i: hashlib.md5(f"11:{i}".encode()).hexdigest()
    want = []
    for s, quota in (("big", round(40 * 1850 / 2051)), (None, round(40 * 200 / 2051)), ("one", 1)):
        want += sorted((order(i), i, s or "") for i, x in rows if x == s)[:quota]
    assert sorted((order(r["id"]), r["id"], r["s"] or "") for r in got) == sorted(want)[:40]
