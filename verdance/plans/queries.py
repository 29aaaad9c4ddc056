"""Queries over the driver's tables, each with its equivalent for DuckDB where SQL can express it.

Decisions: gold is labels.quality = 1, predicted a rule on n_chars, confidence a rule on doc_id,
groups lang and source. Facts: the events of each user by event type. Sentences: the lines of
documents and conversations. Reported decimals are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, intervals, logic, text
from ..operators import agreement, digests, errors, generation, ordered, runs, sampling, scoring, segmentation, trend, validation
from ..sources import answers, pages, search
from .stages import shared_path, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Decisions.


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("toxic"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = scoring.decisions(docs.withColumnRenamed("doc_id", "item_id"), gold.withColumnRenamed("doc_id", "item_id"))
    return rows.withColumns({"predicted": F.col("n_chars") >= 300, "confidence": (F.pmod(F.col("item_id") * 37, F.lit(21)) / 20)})


D = """d AS (SELECT doc_id AS item_id, quality = 1 AS gold, toxic = 1 AS toxic, lang, source, n_chars, n_chars >= 300 AS predicted,
  CAST((doc_id * 37) % 21 AS DOUBLE) / 20 AS confidence FROM labels JOIN documents USING (doc_id)), k AS (SELECT * FROM d WHERE gold IS NOT NULL AND predicted IS NOT NULL)"""
Z = "1.959963984540054"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, m = f"({k} / CAST({n} AS DOUBLE))", f"CAST({n} AS DOUBLE)"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {m} + {Z} * {Z} / (4 * {m} * {m}))"
    low, high = (f"(({p} + {Z} * {Z} / (2 * {m}) {s} {half}) / (1 + {Z} * {Z} / {m}))" for s in "-+")
    return f"CASE WHEN {low} < 1e-9 THEN 0.0 ELSE {low} END", f"CASE WHEN {high} > 1 - 1e-9 THEN 1.0 ELSE {high} END"


LOW, HIGH = _wilson_sql("n_correct", "n")


@query(f"""WITH {D}, g AS (SELECT CASE WHEN grouping(l) = 1 THEN 'overall' ELSE l END AS grp, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct, count(*) FILTER (WHERE gold) AS n_gold
  FROM (SELECT *, coalesce(lang, 'ungrouped') AS l FROM k) GROUP BY GROUPING SETS ((l), ()))
SELECT grp, n, n_correct, round(n_correct / CAST(n AS DOUBLE), 6) AS accuracy, round({LOW}, 6) AS low, round({HIGH}, 6) AS high, round(n_gold / CAST(n AS DOUBLE), 6) AS gold_rate FROM g WHERE n > 0""")
def group_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with its interval by language and overall."""
    return _rounded(scoring.group_scores(_decisions(spark, sf_dir), "lang"))


@query(f"""WITH {D}, c AS (SELECT label, count(*) FILTER (WHERE gold = label AND predicted = label) AS tp, count(*) FILTER (WHERE gold <> label AND predicted = label) AS fp, count(*) FILTER (WHERE gold = label AND predicted <> label) AS fn
  FROM k, (VALUES (true), (false)) v(label) WHERE gold = label OR predicted = label GROUP BY label),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS r FROM c)
SELECT CAST(label AS VARCHAR) AS label, tp, fp, fn, tp + fn AS support, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM s""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.class_scores(_decisions(spark, sf_dir)))


@query(f"""WITH {D}, c AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE gold AND predicted) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT gold AND predicted) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE gold AND NOT predicted) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT gold AND NOT predicted) AS DOUBLE) AS tn FROM k),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS ft, CASE WHEN tn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0.0 END AS ff, CAST(tp + fp + fn > 0 AS INT) + CAST(tn + fp + fn > 0 AS INT) AS c FROM c)
SELECT n, round((tp + tn) / n, 6) AS accuracy, round((tp + tn) / n, 6) AS micro_f1, round((ft + ff) / c, 6) AS macro_f1, round((ft + ff) / 2, 6) AS macro_f1_both,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy FROM f""")
def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.headline(_decisions(spark, sf_dir)))


@query(f"""WITH {D}, s AS (SELECT 'all' AS subset, gold = predicted AS ok FROM k UNION ALL SELECT 'clean', gold = predicted FROM k WHERE NOT toxic UNION ALL SELECT 'clean_long', gold = predicted FROM k WHERE NOT toxic AND n_chars >= 100),
g AS (SELECT subset, count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct FROM s GROUP BY subset)
SELECT subset, n, n_correct, round(n_correct / CAST(n AS DOUBLE), 6) AS accuracy, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM g""")
def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = ~F.col("toxic")
    return _rounded(scoring.subset_scores(_decisions(spark, sf_dir), {"all": F.lit(True), "clean": clean, "clean_long": clean & (F.col("n_chars") >= 100)}))


BIN = "greatest(CAST(ceil(confidence * 10) AS INT) - 1, 0)"


@query(f"""WITH {D} SELECT lang, {BIN} AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CAST(gold = predicted AS DOUBLE)), 6) AS accuracy FROM k GROUP BY lang, {BIN}""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.calibration_bins(_decisions(spark, sf_dir), "lang"))


@query(f"""WITH {D}, b AS (SELECT source, {BIN} AS bin, count(*) AS n, abs(sum(CAST(gold = predicted AS DOUBLE)) - sum(confidence)) AS gap FROM k GROUP BY ALL),
c AS (SELECT source, count(DISTINCT round(confidence, 12)) AS m FROM k GROUP BY source)
SELECT b.source, CAST(sum(n) AS BIGINT) AS n, round(sum(gap) / sum(n), 6) AS ece, any_value(m) AS n_confidences, any_value(m) <= 1 AS degenerate FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source GROUP BY b.source""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.calibration(_decisions(spark, sf_dir), "source"))


@query(f"""WITH {D}, l AS (SELECT lang, confidence, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS ok FROM k GROUP BY lang, confidence),
r AS (SELECT *, sum(n) OVER w AS nu, sum(ok) OVER w AS ou, sum(n) OVER (PARTITION BY lang) AS t FROM l WINDOW w AS (PARTITION BY lang ORDER BY confidence DESC)),
c AS (SELECT r.*, v AS coverage, greatest(1, CAST(round_even(CAST(t AS DOUBLE) * (v / 100.0), 0) AS BIGINT)) AS kk FROM r, (SELECT unnest([10,20,30,40,50,60,70,80,90,100]) AS v))
SELECT lang, CAST(coverage AS INT) AS coverage, CAST(kk AS BIGINT) AS k, round(((ou - ok) + (kk - (nu - n)) * ok / CAST(n AS DOUBLE)) / kk, 6) AS accuracy FROM c WHERE nu >= kk AND nu - n < kk""")
def selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.selective_accuracy(_decisions(spark, sf_dir), "lang"))


@query(f"""WITH {D}, g AS (SELECT lang, source, count(*) AS n, round(avg(CAST(gold = predicted AS DOUBLE)), 6) AS accuracy FROM k GROUP BY lang, source)
SELECT lang || '/' || source AS board, n, accuracy FROM g ORDER BY accuracy DESC, board""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.known(_decisions(spark, sf_dir)).groupBy(F.concat("lang", F.lit("/"), "source").alias("board")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return scoring.ranked(rows, "accuracy", "board")


@query(f"""WITH {D}, g AS (SELECT lang || '/' || source AS board, avg(CAST(gold = predicted AS DOUBLE)) AS value FROM k WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source)
SELECT board, round(value, 2) AS claimed, round(value, 6) AS value FROM g WHERE abs(round(value, 2) - value) > 0.0006""")
def misstated_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that states each board's accuracy to two decimals, read back and held against the decisions."""
    rows = scoring.known(_decisions(spark, sf_dir)).where("lang IS NOT NULL AND source IS NOT NULL").groupBy(F.concat("lang", F.lit("/"), "source").alias("board")).agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("value"))
    rows = written(rows, "boards")
    stated = rows.select("board", F.concat(F.lit("| "), "board", F.lit(" | accuracy **"), F.round("value", 2).cast("string"), F.lit("** |")).alias("line"))
    claims = stated.select("board", F.explode(validation.figures(F.col("line"), r"accuracy \*\*([0-9.]+)\*\*")).alias("claimed"))
    return _rounded(validation.misstated(claims, rows, ["board"]))


@query(f"""WITH {D}, g AS (SELECT lang, avg(CAST(gold = predicted AS DOUBLE)) AS p FROM k WHERE lang IS NOT NULL GROUP BY lang)
SELECT a.lang AS lang_a, b.lang AS lang_b, CAST(CASE WHEN abs(a.p - b.p) < 1e-12 THEN -1 ELSE greatest(1, ceil(pow({Z} * sqrt(2 * (a.p + b.p) / 2 * (1 - (a.p + b.p) / 2)) + 0.8416212335729143 * sqrt(a.p * (1 - a.p) + b.p * (1 - b.p)), 2) / pow(a.p - b.p, 2))) END AS BIGINT) AS n_needed
FROM g a JOIN g b ON a.lang < b.lang""")
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a group would tell the accuracy of two languages apart. A self-join of groups."""
    g = scoring.known(_decisions(spark, sf_dir)).where("lang IS NOT NULL").groupBy("lang").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("p"))
    a, b = g.select(F.col("lang").alias("lang_a"), F.col("p").alias("pa")), g.select(F.col("lang").alias("lang_b"), F.col("p").alias("pb"))
    return a.join(b, F.col("lang_a") < F.col("lang_b")).select("lang_a", "lang_b", intervals.sample_size(F.col("pa"), F.col("pb")).alias("n_needed"))


# Trends. Level: the size of a document as a power of two; right: the decision.


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.levels(scoring.known(_decisions(spark, sf_dir)).where("n_chars > 0"), F.floor(F.log2("n_chars")), F.col("gold") == F.col("predicted"))


LV = f"{D}, v AS (SELECT CAST(floor(log2(n_chars)) AS DOUBLE) AS x, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct FROM k WHERE n_chars > 0 GROUP BY 1)"


@query(f"""WITH {LV} SELECT x, n, n_correct AS k, round(n_correct / CAST(n AS DOUBLE), 6) AS accuracy, round({LOW}, 6) AS low, round({HIGH}, 6) AS high,
  coalesce(n_correct / CAST(n AS DOUBLE) > lag(n_correct / CAST(n AS DOUBLE)) OVER (ORDER BY x) + 1e-12, false) AS rises FROM v""")
def accuracy_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trend.level_scores(_levels(spark, sf_dir)))


@query(f"""WITH {LV}, r AS (SELECT x, n_correct / CAST(n AS DOUBLE) AS a FROM v),
q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra FROM r)
SELECT count(*) AS n, round(CASE WHEN count(*) > 1 AND var_pop(rx) > 0 AND var_pop(ra) > 0 THEN covar_pop(rx, ra) / sqrt(var_pop(rx) * var_pop(ra)) ELSE 0.0 END, 6) AS rho FROM q""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trend.spearman(_levels(spark, sf_dir).withColumn("a", F.col("k") / F.col("n")), "x", "a"))


@query("""SELECT count(*) AS n, round(CASE WHEN var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0 THEN covar_pop(l_quantity, l_extendedprice) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)) ELSE 0.0 END, 6) AS r FROM lineitem""")
def linear_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trend.pearson(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query()
def permutation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.permutation_test(_levels(spark, sf_dir))


PAIR_NEED = f"pow({Z} * sqrt(2 * (a.p + b.p) / 2 * (1 - (a.p + b.p) / 2)) + 0.8416212335729143 * sqrt(a.p * (1 - a.p) + b.p * (1 - b.p)), 2) / pow(a.p - b.p, 2)"


@query(f"""WITH {LV}, g AS (SELECT x, n_correct / CAST(n AS DOUBLE) AS p, round({LOW}, 4) AS low, round({HIGH}, 4) AS high FROM v)
SELECT a.x AS x_a, b.x AS x_b, round(a.p, 6) AS accuracy_a, round(b.p, 6) AS accuracy_b, a.high >= b.low AND b.high >= a.low AS overlap,
  CAST(CASE WHEN NOT (a.high >= b.low AND b.high >= a.low) THEN 0 WHEN abs(a.p - b.p) < 1e-12 THEN -1 ELSE greatest(1, ceil({PAIR_NEED})) END AS BIGINT) AS n_needed
FROM g a JOIN g b ON a.x < b.x""")
def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trend.level_pairs(_levels(spark, sf_dir)))


@query(f"""WITH v AS (SELECT CAST(l_suppkey AS DOUBLE) AS x, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_correct FROM lineitem WHERE l_suppkey IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1), g AS (SELECT x, n_correct / CAST(n AS DOUBLE) AS p, round({LOW}, 4) AS low, round({HIGH}, 4) AS high FROM v)
SELECT a.x AS x_a, b.x AS x_b, round(a.p, 6) AS accuracy_a, round(b.p, 6) AS accuracy_b, CAST(CASE WHEN abs(a.p - b.p) < 1e-12 THEN -1 ELSE greatest(1, ceil({PAIR_NEED})) END AS BIGINT) AS n_needed FROM g a JOIN g b ON a.x < b.x AND a.high >= b.low AND b.high >= a.low""")
def overlapping_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose shares of returned lines can't be told apart, with the lines each that it would take."""
    return trend.overlapping_levels(trend.levels(_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_returnflag") == "R"), digits=6)


@query("""WITH q AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT count(*) AS n, round(CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) ELSE 0.0 END, 6) AS rho FROM q""")
def line_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over all lines: nearly each has a price of its own."""
    return _rounded(trend.spearman(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


# Newton's method on the levels: one row a step.
NEWTON = f"""{LV}, it AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT i + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT i, a, b, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) AS h2, sum(n_correct - n * p) AS g0, sum((n_correct - n * p) * x) AS g1
    FROM (SELECT i, a, b, x, n, n_correct, 1 / (1 + exp(-(a + b * x))) AS p FROM it, v WHERE i < 30) GROUP BY i, a, b)),
model AS (SELECT a, b FROM it WHERE i = 30)"""


@query()
def item_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic trend of correctness over document size, with a permutation test."""
    return trend.item_trend(_levels(spark, sf_dir))


@query(f"""WITH RECURSIVE {NEWTON}, w AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(n) AS n, sum(n_correct) AS n_correct, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) AS h2
  FROM (SELECT a, b, x, n, n_correct, 1 / (1 + exp(-(a + b * x))) AS p FROM model, v)), e AS (SELECT *, sqrt(h0 / (h0 * h2 - h1 * h1)) AS se FROM w)
SELECT CAST(n AS BIGINT) AS n, CAST(n_correct AS BIGINT) AS n_correct, round(a, 6) AS intercept, round(b, 6) AS slope, round(se, 6) AS se, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z} * se), 6) AS or_low, round(exp(b + {Z} * se), 6) AS or_high FROM e""")
def item_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic model behind item_trend."""
    return _rounded(trend.item_trend(_levels(spark, sf_dir), replicates=0).select("n", "n_correct", "intercept", "slope", "se", "odds_ratio", "or_low", "or_high"))


@query(f"WITH RECURSIVE {NEWTON} SELECT x, round(1 / (1 + exp(-(a + b * x))), 6) AS p FROM model, (SELECT CAST(unnest([4, 6, 8, 10, 12]) AS DOUBLE) AS x)")
def predicted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trend.predicted(_levels(spark, sf_dir), [4.0, 6.0, 8.0, 10.0, 12.0]))


@query()
def trend_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of 1000 simulated tables with the levels' sizes and accuracies the trend is found to decline."""
    return trend.power_of(_levels(spark, sf_dir), 1000)


# Agreement: quality against a rule, as two annotators.


def _annotators(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    a = labels.select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "temporal").when(F.col("quality") == 1, "none").otherwise("numeric_threshold").alias("category"), (F.col("toxic") == 1).alias("clinical"))
    b = docs.where("n_chars >= 50").select(F.col("doc_id").alias("item_id"), F.when(F.col("n_chars") % 11 == 0, "temporal").when(F.col("n_chars") >= 200, "none").otherwise("numeric_threshold").alias("category"), "lang")
    return a, b


AN = """a AS (SELECT doc_id AS item_id, CASE WHEN max(toxic) = 1 THEN 'temporal' WHEN max(quality) = 1 THEN 'none' ELSE 'numeric_threshold' END AS a, max(toxic) = 1 AS clinical FROM labels GROUP BY doc_id),
b AS (SELECT doc_id AS item_id, CASE WHEN n_chars % 11 = 0 THEN 'temporal' WHEN n_chars >= 200 THEN 'none' ELSE 'numeric_threshold' END AS b, lang FROM documents WHERE n_chars >= 50), p AS (SELECT * FROM a JOIN b USING (item_id))"""


def _slices_sql(rows: str) -> str:
    return f"""x AS ({rows}), t AS (SELECT slice, value, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM x GROUP BY slice, value),
m AS (SELECT slice, value, label, sum(ia) AS na, sum(ib) AS nb FROM (SELECT slice, value, a AS label, 1 AS ia, 0 AS ib FROM x UNION ALL SELECT slice, value, b, 0, 1 FROM x) GROUP BY ALL),
e AS (SELECT slice, value, sum(CAST(na AS DOUBLE) * nb) AS products FROM m GROUP BY ALL),
f AS (SELECT t.slice, t.value, n, agree / CAST(n AS DOUBLE) AS po, products / (CAST(n AS DOUBLE) * n) AS pe FROM t JOIN e USING (slice, value))
SELECT slice, value, n, round(po, 6) AS agreement, round(pe, 6) AS expected, round(CASE WHEN pe < 1 - 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM f"""


@query(f"WITH {AN}, " + _slices_sql("SELECT a, b, 'overall' AS slice, 'all' AS value FROM p UNION ALL SELECT a, b, 'lang', lang FROM p WHERE lang IS NOT NULL UNION ALL SELECT a, b, 'clinical', CAST(clinical AS VARCHAR) FROM p"))
def agreement_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _annotators(spark, sf_dir)
    pairs = a.withColumnRenamed("category", "a").join(b.withColumnRenamed("category", "b"), "item_id")
    return _rounded(agreement.by_slices(pairs, {"lang": F.col("lang"), "clinical": F.col("clinical")}))


@query(f"""WITH {AN}, c AS (SELECT DISTINCT unnest([a, b]) AS category FROM p), t AS (SELECT category, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE a = category) AS n_a, count(*) FILTER (WHERE b = category) AS n_b, count(*) FILTER (WHERE a = category AND b = category) AS n_both FROM p, c GROUP BY category),
f AS (SELECT *, (n - n_a - n_b + 2 * n_both) / n AS po, (CAST(n_a AS DOUBLE) * n_b + (n - n_a) * (n - n_b)) / (n * n) AS pe FROM t)
SELECT category, n_a, n_b, n_both, round(po, 6) AS agreement, round(CASE WHEN pe < 1 - 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM f""")
def agreement_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.per_category(agreement.aligned(*_annotators(spark, sf_dir))))


@query(f"""WITH {AN} SELECT (SELECT count(*) FROM p) AS "both", (SELECT count(*) FROM a ANTI JOIN b USING (item_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (item_id)) AS only_b""")
def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.only(*_annotators(spark, sf_dir))


@query(f"""WITH {AN} SELECT item_id, a, b, clinical, CASE WHEN clinical THEN 'annotator1_governs' ELSE 'resolve_on_merits' END AS rule FROM p WHERE a <> b""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _annotators(spark, sf_dir)
    return agreement.disagreements(agreement.aligned(a, b).join(a.select("item_id", "clinical"), "item_id"), F.col("clinical"))


@query(f"""WITH {AN} SELECT item_id, CASE WHEN a = b THEN a WHEN clinical THEN a ELSE b END AS category FROM p""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _annotators(spark, sf_dir)
    pairs = agreement.aligned(a, b)
    settled = agreement.disagreements(pairs.join(a.select("item_id", "clinical"), "item_id"), F.col("clinical")).select("item_id", F.when(F.col("clinical"), F.col("a")).otherwise(F.col("b")).alias("category"))
    return agreement.consensus(pairs, settled)


@query()
def kappa_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa_interval(agreement.aligned(*_annotators(spark, sf_dir)))


# Trees over facts: what each user's events say by the end of the table.

ANCHOR = "TIMESTAMP '2024-04-01 00:00:00'"
#: Fixed criteria over the event types, as trees.
CRITERIA: dict[str, list[dict]] = {
    "recent_purchase": logic.atom("purchase", "measurement", ("ge", 50.0), ("within", 2, "weeks")),
    "view_not_click": logic.group("and", logic.atom("view", "observation"), logic.negation(logic.atom("click", "observation", ("gt", 20.0)))),
    "any_strong": logic.group("or", logic.atom("purchase", "measurement", ("between", 10.0, 90.0)), logic.atom("signup", "observation", None, ("current",)), logic.atom("click", "observation", ("lt", 5.0))),
    "nested": logic.negation(logic.group("and", logic.group("or", logic.atom("view", "observation", ("le", 40.0)), logic.negation(logic.atom("error", "observation", None, ("for_at_least", 1, "months")))), logic.group("or", logic.atom("purchase", "measurement", ("ne", 0.0)), logic.group("and", logic.atom("click", "observation"), logic.atom("logout", "observation", None, ("any_history",)))))),
    "flat_or": logic.group("or", logic.group("or", logic.atom("view", "observation"), logic.atom("click", "observation")), logic.atom("view", "observation"), logic.negation(logic.negation(logic.atom("purchase", "measurement")))),
}
ENTITIES = sorted({n["entity"] for t in CRITERIA.values() for n in t if n["kind"] == "atom"})


def facts_by_user(events: DataFrame) -> DataFrame:
    """user_id and facts: per event type the last value, days since the last event before a fixed anchor, and whether that is a day at most."""
    last = F.max(F.struct("ts", "event_id", "value"))
    by = events.where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", "event_type").agg(last.alias("l"))
    ago = (F.unix_micros(F.expr(ANCHOR)) - F.unix_micros(F.col("l.ts").cast("timestamp"))) / F.lit(86400e6)
    fact = F.struct(F.lit(True).alias("present"), F.col("l.value").alias("value"), ago.alias("days_ago"), (ago <= 1).alias("current"))
    pairs = by.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("k"), fact.alias("v"))).alias("p"))  # one element an event type
    return pairs.select("user_id", F.map_from_entries("p").alias("facts"))


FACT_COLUMNS = ", ".join(
    f"bool_or(true) FILTER (WHERE event_type = '{e}') AS {e}_present, max(value) FILTER (WHERE event_type = '{e}') AS {e}_value, max(ago) FILTER (WHERE event_type = '{e}') AS {e}_days_ago, bool_or(ago <= 1) FILTER (WHERE event_type = '{e}') AS {e}_current" for e in ENTITIES
)
FU = f"""l AS (SELECT user_id, event_type, value, (epoch_us({ANCHOR}) - epoch_us(ts)) / CAST(86400e6 AS DOUBLE) AS ago, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
u AS (SELECT user_id, {FACT_COLUMNS} FROM l WHERE r = 1 GROUP BY user_id)"""


def _sql_value(tree: list[dict]) -> str:
    return logic.to_sql(tree, lambda e: {c: f"{e}_{c}" for c in ("present", "value", "days_ago", "current")})


@query(f"WITH {FU} SELECT user_id, " + ", ".join(f"{_sql_value(t)} AS {name}, coalesce({_sql_value(t)}, false) AS {name}_met" for name, t in CRITERIA.items()) + " FROM u")
def criteria_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each criterion for each user, three-valued, and collapsed."""
    facts = facts_by_user(_table(spark, sf_dir, "events"))
    return facts.select("user_id", *(c for name, t in CRITERIA.items() for c in (logic.evaluate(logic.literal(t), F.col("facts")).alias(name), logic.is_met(logic.literal(t), F.col("facts")).alias(f"{name}_met"))))


@query(f"WITH {FU} SELECT user_id, " + ", ".join(f"CAST({' + '.join(f'CAST({n["entity"]}_present IS NULL AS INT)' for n in t if n['kind'] == 'atom')} AS INT) AS {name}" for name, t in CRITERIA.items()) + " FROM u")
def undocumented_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_by_user(_table(spark, sf_dir, "events"))
    return facts.select("user_id", *(logic.undocumented(logic.literal(t), F.col("facts")).alias(name) for name, t in CRITERIA.items()))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with each criterion as an item, its gold, and what the negation-blind reader says."""
    facts = facts_by_user(_table(spark, sf_dir, "events"))
    trees = F.array(*(F.struct(F.lit(name).alias("criterion"), logic.literal(t).alias("tree")) for name, t in CRITERIA.items()))
    rows = facts.select("user_id", "facts", F.explode(trees).alias("c")).select(F.concat_ws(":", F.col("user_id").cast("string"), "c.criterion").alias("item_id"), "c.criterion", "c.tree", "facts")
    return rows.withColumns({"gold": logic.is_met(F.col("tree"), F.col("facts")), "predicted": F.coalesce(logic.degraded(F.col("tree"), F.col("facts")), F.lit(False)), "confidence": F.lit(0.7), "rationale": F.concat(F.lit("read "), "criterion")})


def _degraded_tree(tree: list[dict]) -> list[dict]:
    """The tree in Python without negations, alternatives cut to their first branch, for the oracle."""
    stack: list[list[dict]] = []
    for n in tree:
        if n["kind"] == "atom":
            stack.append([n])
        elif n["kind"] != "not":
            args = stack[len(stack) - n["arity"] :]
            del stack[len(stack) - n["arity"] :]
            stack.append(logic.group("and", *args) if n["kind"] == "and" else args[0])
    return stack[-1]


def _probe(tree: list[dict], prefix: str | None) -> list[dict]:
    if prefix is None:
        return [n for n in tree if n["kind"] != "not"]
    return [{k: None if k.startswith(prefix) else v for k, v in n.items()} for n in tree]


def _category_sql(tree: list[dict]) -> str:
    depth = any(n["kind"] in ("and", "or") for n in tree)
    arms = [(any(n["kind"] == "not" for n in tree), None, "negation_polarity"), (any(n["tmp_op"] for n in tree), "tmp_", "temporal"), (any(n["num_op"] for n in tree), "num_", "numeric_threshold")]
    whens = "".join(f" WHEN coalesce({_sql_value(_probe(tree, prefix))} = predicted, false) THEN '{name}'" for has, prefix, name in arms if has)
    last = "'logical_composition'" if depth else "'none'"
    return f"CASE {whens} ELSE {last} END" if whens else last


_JUDGED_SQL = " UNION ALL ".join(f"SELECT *, {_category_sql(t)} AS category FROM (SELECT *, '{name}' AS criterion, coalesce({_sql_value(t)}, false) AS gold, coalesce({_sql_value(_degraded_tree(t))}, false) AS predicted FROM u)" for name, t in CRITERIA.items())
_CURRENT = " WHEN ".join(["CASE"] + [f"criterion = '{name}' THEN " + (" OR ".join(f"coalesce({n['entity']}_present AND NOT {n['entity']}_current, false)" for n in t if n["tmp_op"] == "current") or "false") for name, t in CRITERIA.items()]) + " END"


@query(f"WITH {FU}, j AS ({_JUDGED_SQL}), e AS (SELECT *, {_CURRENT} AS unanswerable FROM j WHERE gold <> predicted) SELECT category, count(*) FILTER (WHERE NOT unanswerable) AS n_scored, count(*) FILTER (WHERE unanswerable) AS n_withheld FROM e GROUP BY category")
def failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the negation-blind reader errs, by counterfactual probes."""
    return errors.breakdown(errors.labelled(_judged(spark, sf_dir)))


@query(f"WITH {FU}, j AS ({_JUDGED_SQL}), e AS (SELECT *, {_CURRENT} AS unanswerable FROM j WHERE gold <> predicted), c AS (SELECT criterion, count(*) AS n, count(*) FILTER (WHERE unanswerable) AS u FROM e GROUP BY criterion) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_errors, CAST(coalesce(sum(u), 0) AS BIGINT) AS n_unanswerable, count(*) AS distinct_rationales, coalesce(max(n), 0) AS largest_cluster FROM c")
def failure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.evidence(errors.labelled(_judged(spark, sf_dir)))


@query(f"WITH {FU}, j AS ({_JUDGED_SQL}), g AS (SELECT criterion AS run, {_CURRENT} AS unanswerable, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct FROM j GROUP BY ALL) SELECT run, unanswerable, n, round(n_correct / CAST(n AS DOUBLE), 6) AS accuracy, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM g")
def exposure_by_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumns({"run": F.col("criterion"), "unanswerable": logic.unanswerable(F.col("tree"), F.col("facts"))})
    return _rounded(runs.exposure(rows))


SUMMARY = f"""{FU}, j AS ({_JUDGED_SQL}), g AS (SELECT criterion AS run, count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct, count(*) FILTER (WHERE gold <> predicted) AS n_errors, count(*) FILTER (WHERE gold <> predicted AND {_CURRENT}) AS u FROM j GROUP BY criterion),
s AS (SELECT run, n, n_correct, round(n_correct / CAST(n AS DOUBLE), 4) AS accuracy, round({LOW}, 4) AS low, round({HIGH}, 4) AS high, n_errors, round(abs(n_correct / CAST(n AS DOUBLE) - 0.7), 4) AS ece, CAST(0.7 AS DOUBLE) AS mean_confidence, CAST(0 AS BIGINT) AS n_abstain, false AS usable_confidence,
  CASE WHEN n_errors > 0 THEN CAST(1 AS BIGINT) END AS distinct_error_rationales, n_errors AS n_errors_with_rationale, CASE WHEN u > 0 THEN u END AS n_unanswerable_errors, true AS has_rationales FROM g)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).withColumns({"run": F.col("criterion"), "level": logic.depth(F.col("tree")), "unanswerable": logic.unanswerable(F.col("tree"), F.col("facts"))})


@query(f"WITH {SUMMARY} SELECT * FROM s")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each criterion as a run of a reader with one confidence and one rationale a run."""
    return _rounded(runs.summaries(_runs(spark, sf_dir)))


@query(f"""WITH {SUMMARY} SELECT run AS subject, gate, severity FROM s, (VALUES ('constant_confidence', 'BLOCK'), ('perfect_score', 'NOTE'), ('repeated_rationales', 'BLOCK'), ('unanswerable_errors', 'BLOCK')) r(gate, severity)
WHERE CASE gate WHEN 'constant_confidence' THEN NOT usable_confidence WHEN 'perfect_score' THEN accuracy = 1 WHEN 'repeated_rationales' THEN n_errors > 2 AND distinct_error_rationales < n_errors ELSE n_unanswerable_errors IS NOT NULL END""")
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gates(runs.summaries(_runs(spark, sf_dir)))


#: What tree_forms must say of each criterion, read off CRITERIA by hand: leaves, and, or, nots, depth, depth of the normal form, text, text of the normal form.
FORMS = {
    "recent_purchase": (1, 0, 0, 0, 0, 0, "purchase >= 50.0 (within the past 2.0 weeks)", "purchase >= 50.0 (within the past 2.0 weeks)"),
    "view_not_click": (2, 1, 0, 1, 1, 1, "(view AND NOT (click > 20.0))", "(NOT (click > 20.0) AND view)"),
    "any_strong": (3, 0, 1, 0, 1, 1, "(purchase between 10.0 and 90.0 OR signup (current / ongoing) OR click < 5.0)", "(click < 5.0 OR purchase between 10.0 and 90.0 OR signup (current / ongoing))"),
    "nested": (5, 2, 2, 2, 3, 3, "NOT (((view <= 40.0 OR NOT (error (for at least 1.0 months))) AND (purchase != 0.0 OR (click AND logout (at any time in history)))))", "NOT ((((click AND logout (at any time in history)) OR purchase != 0.0) AND (NOT (error (for at least 1.0 months)) OR view <= 40.0)))"),
    "flat_or": (4, 0, 2, 2, 2, 1, "((view OR click) OR view OR NOT (NOT (purchase)))", "(click OR purchase OR view)"),
}


def _structure_sql(by: str = "depth") -> str:
    per = " UNION ALL ".join(f"SELECT '{name}' AS criterion, {f[0]} AS leaves, {f[1]} AS ands, {f[2]} AS ors, {f[3]} AS nots, {f[4]} AS depth, {f[5]} AS canonical" for name, f in FORMS.items())
    missing = " ".join(f"WHEN '{name}' THEN {' + '.join(f'CAST({n["entity"]}_present IS NULL AS INT)' for n in t if n['kind'] == 'atom')}" for name, t in CRITERIA.items())
    unclear = " ".join(f"WHEN '{name}' THEN {' + '.join([f'CAST(coalesce({n["entity"]}_present AND NOT {n["entity"]}_current, false) AS INT)' for n in t if n['kind'] == 'atom' and not n['tmp_op']] or ['0'])}" for name, t in CRITERIA.items())
    return f"""WITH {FU}, j AS ({_JUDGED_SQL}), f AS ({per}), r AS (SELECT f.*, gold, predicted, CASE criterion {missing} END AS missing, CASE criterion {unclear} END AS unclear FROM j JOIN f USING (criterion)),
g AS (SELECT {by} AS level, {"round_even(avg(depth), 2) AS depth_mean," if by == "leaves" else ""} count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct, round_even(avg(leaves), 1) AS leaves_mean, min(leaves) AS leaves_min, max(leaves) AS leaves_max, round_even(avg(ands), 1) AS and_mean, round_even(avg(ors), 1) AS or_mean, round_even(avg(nots), 1) AS not_mean,
  round_even(avg(canonical), 2) AS canonical_depth_mean, round_even(avg(missing), 1) AS undocumented_mean, round_even(avg(unclear), 1) AS currency_ambiguous_mean, round_even(avg(CAST(gold AS DOUBLE)), 3) AS gold_met_rate, round_even(avg(CAST(predicted AS DOUBLE)), 3) AS model_met_rate,
  (avg(CAST(gold = predicted AS DOUBLE)) FILTER (WHERE gold) + avg(CAST(gold = predicted AS DOUBLE)) FILTER (WHERE NOT gold)) / 2 AS balanced FROM r GROUP BY {by})
SELECT * EXCLUDE (n_correct, balanced), n_correct AS k, round_even(n_correct / CAST(n AS DOUBLE), 3) AS accuracy, round_even({LOW}, 4) AS low, round_even({HIGH}, 4) AS high, round_even(balanced, 3) AS balanced_accuracy FROM g"""


@query(_structure_sql())
def structure_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return runs.by_level(rows, logic.depth(F.col("tree")))


@query(_structure_sql("leaves"))
def structure_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.by_size(_judged(spark, sf_dir))


def _form_sql(k: int) -> str:
    return f"CASE criterion {' '.join(f"WHEN '{name}' THEN {f[k]}" for name, f in FORMS.items())} END"


@query(f"WITH {FU}, j AS ({_JUDGED_SQL}), f AS (SELECT gold, predicted, {_form_sql(4)} AS d, log2({_form_sql(0)}) AS s FROM j) SELECT count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS n_correct, round(covar_pop(d, s) / sqrt(var_pop(d) * var_pop(s)), 3) AS depth_size_r FROM f")
def structure_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How depth goes with size, and what the item-level trend over depth rests on."""
    return runs.structure_trend(_judged(spark, sf_dir), replicates=0).select("n", "n_correct", "depth_size_r")


@query(f"WITH {FU} SELECT criterion, users, leaves, a AS and_groups, o AS or_groups, nots, a + o AS groups, depth, cd AS canonical_depth, rendered, canonical FROM (VALUES {', '.join(str((name, *f)) for name, f in FORMS.items())}) f(criterion, leaves, a, o, nots, depth, cd, rendered, canonical), (SELECT count(*) AS users FROM u) WHERE users > 0")
def tree_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, rendered text and rendered normal form of the criteria that users are held against, and how many users."""
    rows = _judged(spark, sf_dir).groupBy("criterion").agg(F.first("tree").alias("tree"), F.count(F.lit(1)).alias("users"))
    return rows.select("criterion", "users", logic.structure(F.col("tree")).alias("s"), logic.render(F.col("tree")).alias("rendered"), logic.render(logic.canonical(F.col("tree"))).alias("canonical")).select("criterion", "users", "s.*", "rendered", "canonical")


# Sentences.

ws = r"[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sentences_sql(table: str, ident: str) -> str:
    lists = ", ".join(f"'{p}'" for p in text.BOILERPLATE)
    return rf"""raw AS (SELECT row_number() OVER () AS rid, {ident} AS study_id, regexp_split_to_array(text, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM {table} WHERE {ident} IS NOT NULL AND text IS NOT NULL),
li AS (SELECT rid, study_id, CAST(unnest(range(0, len(a))) AS INT) AS pos, regexp_replace(regexp_replace(unnest(a), '\\([^A-Za-z0-9\s])', '\1', 'g'), '^{ws}+|{ws}+$', '', 'g') AS l FROM raw),
mk AS (SELECT *, regexp_matches(l, '(?i)^\s*(inclusion|exclusion)\s+criteria\b\s*:?\s*$') AS header, CASE WHEN starts_with(lower(l), 'inclusion criteria') THEN 'inclusion' WHEN starts_with(lower(l), 'exclusion criteria') THEN 'exclusion' END AS inl FROM li WHERE l <> ''),
se AS (SELECT rid, study_id, pos, CASE WHEN header THEN lower(regexp_extract(l, '(?i)^\s*(inclusion|exclusion)', 1)) ELSE inl END AS mark,
  CASE WHEN NOT header THEN regexp_replace(regexp_replace(regexp_replace(CASE WHEN inl IS NOT NULL THEN regexp_replace(l, '(?s)^[^:]*:{ws}*', '') ELSE l END, '^{ws}*(?:[-*\x{{2022}}\x{{B7}}]|\(?\d+\\?[.)]){ws}*', ''), '{ws}+', ' ', 'g'), '^ | $', '', 'g') END AS sentence FROM mk),
st AS (SELECT rid, study_id, pos, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY rid ORDER BY pos), 'inclusion') AS section, sentence FROM se),
ss AS (SELECT study_id, pos, section, sentence, CASE WHEN length(sentence) NOT BETWEEN 12 AND 180 THEN 'length_out_of_range' WHEN len(list_filter([{lists}], lambda p: contains(lower(sentence), p))) > 0 THEN 'boilerplate_phrase' END AS skipped FROM st WHERE sentence <> '')"""


@query("WITH " + _sentences_sql("documents", "doc_id") + " SELECT study_id, pos, section, md5(sentence) AS sentence_md5, skipped FROM ss")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a sentence with its section and why it is passed over."""
    return segmentation.sentences(_table(spark, sf_dir, "documents"), "doc_id").select("study_id", "pos", "section", F.md5("sentence").alias("sentence_md5"), "skipped")


@query("WITH " + _sentences_sql("conversations", "conv_id") + " SELECT section, coalesce(skipped, 'kept') AS state, count(*) AS n FROM ss GROUP BY ALL")
def conversation_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.sentences(_table(spark, sf_dir, "conversations"), "conv_id")
    return rows.groupBy("section", F.coalesce("skipped", F.lit("kept")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


# Study texts made of the table part: a line for each extractor, with what it must give.


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id and text of a study for each part."""
    size, name, kind = F.col("p_size").cast("string"), F.col("p_name"), F.lower("p_type")
    months = (F.col("p_size") % 12 + 1).cast("string")
    lines = [
        F.lit("Inclusion Criteria:"), F.lit(""), F.concat(F.lit("* Age "), size, F.lit(" years or older")), F.concat(F.lit("* diagnosis of "), name), F.concat(F.lit("* HbA1c >= "), size, F.lit(".5 %")),
        F.concat(F.lit("Exclusion criteria: history of "), name, F.lit(" within "), months, F.lit(" months")), F.lit("* able to sign a form"), F.concat(F.lit("* treatment with "), name, F.lit(" or use of "), kind, F.lit(" monitoring")), F.concat(F.lit("- No diagnosis of "), name),
    ]
    parts = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    return parts.select(F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("study_id"), F.concat_ws("\n", *lines).alias("text"))


def _different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the study texts, each different one of a section once."""
    return segmentation.alike(segmentation.sentences(_studies(spark, sf_dir)))


PARTS = "p AS (SELECT 'NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS study_id, p_name AS name, lower(p_type) AS kind, p_size AS size, p_size % 12 + 1 AS months FROM part)"
FOUND = """found AS (SELECT study_id, 2 AS pos, 'inclusion' AS section, 'age >= ' || size || '.0 years' AS rendered, 'age_min' AS pattern FROM p
  UNION ALL SELECT study_id, 3, 'inclusion', name, 'condition:diagnosis_of' FROM p UNION ALL SELECT study_id, 4, 'inclusion', 'hba1c >= ' || size || '.5 %', 'measurement_threshold' FROM p
  UNION ALL SELECT study_id, 5, 'exclusion', name || ' (within the past ' || months || '.0 months)', 'condition:history_of' FROM p
  UNION ALL SELECT study_id, 7, 'exclusion', kind || ' monitoring', 'procedure:use_of' FROM p UNION ALL SELECT study_id, 8, 'exclusion', name, 'condition:diagnosis_of' FROM p)"""
MADE = """made AS (SELECT study_id, pos, section, rendered, 0 AS depth FROM found WHERE pos < 7
  UNION ALL SELECT study_id, 7, 'exclusion', '(' || name || ' OR ' || kind || ' monitoring)', 1 FROM p UNION ALL SELECT study_id, 8, 'exclusion', 'NOT (' || name || ')', 0 FROM p)"""


@query(f"WITH {PARTS}, {FOUND} SELECT 'pattern' AS kind, pattern AS name, count(*) AS n FROM found GROUP BY pattern UNION ALL SELECT 'skipped', 'boilerplate_phrase', count(*) FROM p UNION ALL SELECT 'total', 'considered', 7 * count(*) FROM p")
def extraction_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the extractor over the study texts."""
    return segmentation.yield_counts(written(segmentation.with_atoms(_different(spark, sf_dir)), "atoms"))


@query(f"WITH {PARTS}, {FOUND} SELECT rendered, arg_min(study_id, (study_id, pos)) AS study_id, arg_min(pos, (study_id, pos)) AS pos, arg_min(section, (study_id, pos)) AS section, count(*) AS n FROM found GROUP BY rendered")
def atom_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(segmentation.with_atoms(_different(spark, sf_dir)), "atoms")
    return segmentation.distinct_atoms(found).select(logic.render(F.col("hit.tree")).alias("rendered"), "study_id", "pos", "section", "n")


@query(f"""WITH {PARTS}, {FOUND}, {MADE}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, rendered ORDER BY study_id, pos) AS r FROM made) WHERE r = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY pos) - 1 AS k FROM kept)
SELECT 'ctgov:' || study_id || ':' || section[:3] || ':' || lpad(CAST(k AS VARCHAR), 2, '0') AS criterion_id, section AS polarity, depth, rendered FROM numbered""")
def criterion_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the study texts without a cap on a study."""
    made = segmentation.criteria(written(segmentation.with_forms(_different(spark, sf_dir)), "mapped"), per_study=None)
    return made.select("criterion_id", "polarity", "depth", logic.render(F.col("tree")).alias("rendered"))


@query()
def criterion_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its cap, a sequential choice: the tests hold it against a fold."""
    made = segmentation.criteria_of(segmentation.corpus_of(_studies(spark, sf_dir)))
    return made.select("criterion_id", "polarity", "depth", logic.render(F.col("tree")).alias("rendered"))


@query(f"""WITH {PARTS}, {FOUND}, {MADE}, pool AS (SELECT rendered, arg_min(study_id, (study_id, pos)) AS study_id, arg_min(section, (study_id, pos)) AS section, arg_min(pattern, (study_id, pos)) AS pattern FROM found GROUP BY rendered),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, rendered ORDER BY study_id, pos) AS r FROM made) WHERE r = 1)
SELECT 'pool' AS part, measure, count(*) AS n FROM (SELECT unnest(['atoms', 'section:' || section, 'pattern:' || pattern]) AS measure FROM pool) GROUP BY measure
UNION ALL SELECT 'pool', 'studies', count(DISTINCT study_id) FROM pool UNION ALL SELECT 'corpus', 'studies', count(DISTINCT study_id) FROM kept
UNION ALL SELECT 'corpus', measure, count(*) FROM (SELECT unnest(['criteria', 'polarity:' || section, 'depth:' || depth]) AS measure FROM kept) GROUP BY measure""")
def dataset_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pool and the uncapped corpus of the study texts consist of."""
    rows = _different(spark, sf_dir)
    seen = F.col("skipped").isNull()
    rows = written(rows.withColumns({"hit": F.when(seen, text.sentence_atom(F.col("sentence"))), "form": F.when(seen, text.sentence_expression(F.col("sentence")))}), "extracted")
    return segmentation.composition(segmentation.distinct_atoms(rows), segmentation.criteria(rows, per_study=None))


POSTED = "printf('2024-%02d-%02d', size % 12 + 1, size % 28 + 1)"


@query(f"""WITH {PARTS}, {FOUND}, pool AS (SELECT rendered, arg_min(study_id, (study_id, pos)) AS study_id FROM found GROUP BY rendered), d AS (SELECT study_id, {POSTED} AS posted FROM p)
SELECT count(*) AS n_atoms, count(DISTINCT study_id) AS n_studies, (SELECT 7 * count(*) FROM p) AS considered, (SELECT count(*) FROM found) AS matched, round((SELECT count(*) FROM found) / CAST((SELECT 7 * count(*) FROM p) AS DOUBLE), 4) AS match_rate, min(posted) AS first_posted_from, max(posted) AS first_posted_to FROM pool JOIN d USING (study_id)""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pool of the study texts rests on: how many sentences match, and from when its studies are."""
    found = written(segmentation.with_atoms(_different(spark, sf_dir)), "atoms")
    dates = _table(spark, sf_dir, "part").select(F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("study_id"), F.format_string("2024-%02d-%02d", F.col("p_size") % 12 + 1, F.col("p_size") % 28 + 1).alias("first_posted"))
    return segmentation.pool_summary(found, segmentation.distinct_atoms(found), dates)


@query(f"""WITH {PARTS}, {FOUND}, {MADE}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, rendered ORDER BY study_id, pos) AS r FROM made) WHERE r = 1), n AS (SELECT count(*) AS n FROM p)
SELECT * FROM (SELECT 'total' AS kind, 'considered' AS name, 7 * n AS n FROM n UNION ALL SELECT 'total', 'mapped', count(*) FROM kept UNION ALL SELECT 'total', 'mapped_coordinated', count(*) FROM kept WHERE depth > 0 UNION ALL SELECT 'total', 'negated', count(*) FROM kept WHERE pos = 8
  UNION ALL SELECT 'skipped', 'boilerplate_phrase', n FROM n UNION ALL SELECT 'skipped', 'duplicate_of_earlier_trial', 6 * n - (SELECT count(*) FROM kept) FROM n) WHERE n > 0""")
def segmentation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the uncapped corpus of the study texts."""
    rows = written(segmentation.with_forms(_different(spark, sf_dir)), "mapped")
    return segmentation.corpus_counts(rows, segmentation.corpus(rows, None), None)


@query(f"""WITH {PARTS}, {FOUND}, {MADE} SELECT study_id, pos, CASE WHEN pos = 7 THEN 2 ELSE 1 END AS leaves, CASE WHEN pos = 7 THEN 1 ELSE 0 END AS or_groups, CASE WHEN pos = 8 THEN 1 ELSE 0 END AS nots, depth, depth AS canonical_depth, rendered FROM made""")
def study_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure and rendered text of every form of the study texts."""
    tree = F.col("form.tree")
    made = segmentation.each_sentence(*segmentation.sentences_with_forms(_studies(spark, sf_dir), {"s": logic.structure(tree), "rendered": logic.render(tree)}), "s", "rendered")
    return made.select("study_id", "pos", "s.leaves", "s.or_groups", "s.nots", "s.depth", "s.canonical_depth", "rendered")


# Search: an index of the documents, and one of the study texts.


def _search_sql(studies: str, asked: str, k: int, need: str) -> str:
    """BM25 in whole millionths, as sources.search has it."""
    return rf"""WITH s AS ({studies}), w AS (SELECT study_id, regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}\p{{N}}]+') AS w FROM s),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT study_id, len(w) AS length, unnest(w) AS term FROM w),
p AS (SELECT term, study_id, any_value(length) AS length, count(*) AS tf FROM t GROUP BY term, study_id), d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY term),
q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'))) AS term FROM ({asked})), c AS (SELECT query_id, count(*) AS words FROM q GROUP BY query_id),
x AS (SELECT query_id, study_id, CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({search.K1} + 1) / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / mean)) * 1000000) AS BIGINT) AS part FROM q JOIN p USING (term) JOIN d USING (term), m),
g AS (SELECT query_id, study_id, CAST(sum(part) AS BIGINT) AS score FROM x GROUP BY query_id, study_id {f"HAVING count(*) = (SELECT words FROM c WHERE c.query_id = x.query_id)" if need == "all" else ""}),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, study_id) AS INT) AS rank, study_id, score FROM g)
SELECT query_id, rank, study_id, score FROM r WHERE rank <= {k}"""


@query(_search_sql("SELECT CAST(doc_id AS VARCHAR) AS study_id, min(coalesce(text, '')) AS body FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id", "SELECT item_id AS query_id, text FROM benchmark", 10, "any"))
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that go best with each text of the benchmark, by any of its words."""
    index = search.Index(spark, shared_path(spark, "search"))
    index.add(_table(spark, sf_dir, "documents"), "doc_id")
    return index.search_all(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query(_search_sql(r"""SELECT 'NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS study_id, p_name || chr(10) || lower(p_type) AS body FROM part""", "SELECT DISTINCT p_type AS query_id, p_type AS text FROM part", 20, "all"))
def study_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The studies with all words of each type, of an index filled in two parts."""
    parts = _table(spark, sf_dir, "part")
    studies = parts.select(F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("study_id"), F.col("p_name").alias("title"), F.lower("p_type").alias("text"), "p_size")
    index = search.Index(spark, shared_path(spark, "search"))
    index.add(studies.where("p_size <= 25"), "study_id", "title", "text")
    index.add(studies, "study_id", "title", "text")
    return index.search_all(parts.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("text")).distinct(), 20, "all")


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN chr(39) || text ELSE text END AS cell, CASE WHEN regexp_matches(text, '^\x27[=+\-@\t\r]') THEN text[2:] ELSE text END AS restored,
  sha256(CAST(conv_id AS VARCHAR) || chr(0) || coalesce(text, '')) AS cache_key FROM conversations""")
def safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", cells.neutralised(F.col("text")).alias("cell"), cells.restored(cells.neutralised(F.col("text"))).alias("restored"), cells.cache_key(F.col("conv_id").cast("string"), F.col("text")).alias("cache_key"))


# Validation, joins and choice.


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of more than one turn, as ids that occur more than once."""
    return validation.duplicate_ids(_table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT doc_id AS id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def coverage_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels of unknown documents."""
    return validation.coverage(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")))


@query("SELECT DISTINCT event_type AS version FROM events")
def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.versions(_table(spark, sf_dir, "events"), "event_type")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def leaked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return validation.leaked(left, _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)")
def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(large, "c_custkey", "left_semi")


@query("SELECT o_custkey, min(o_orderdate) AS o_orderdate, min_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_per_key(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 4")
def first_lines_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four lines of each supplier: a top-k report."""
    return sampling.top_per_key(_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", 4, "l_orderkey", "l_linenumber")


@query("""WITH n AS (SELECT count(*) AS t FROM customer), q AS (SELECT c_mktsegment, greatest(1, CAST(round_even(least(100, any_value(t)) * count(*) / CAST(any_value(t) AS DOUBLE), 0) AS BIGINT)) AS quota FROM customer, n GROUP BY c_mktsegment),
r AS (SELECT c_custkey, c_mktsegment, md5('11:' || c_custkey) AS o, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('11:' || c_custkey)) AS k FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN q USING (c_mktsegment) WHERE k <= quota ORDER BY o LIMIT 100""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred customers in proportion to segments: a sampling operator."""
    return sampling.stratified(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 100)


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('7:' || o_custkey)) AS p, count(*) OVER () AS n FROM k)
SELECT o_orderkey, o_custkey, CASE WHEN p <= greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'test' ELSE 'train' END AS side FROM orders JOIN r USING (o_custkey)""")
def split_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the customers, with all their orders, on the test side."""
    train, test = sampling.split_by_key(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test"))).select("o_orderkey", "o_custkey", "side")


@query("""WITH r AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT CAST((k - 1) // 40 AS BIGINT) AS pos, CAST((k - 1) % 40 AS INT) AS place, c_custkey, c_name FROM r WHERE k <= n * 3 // 4""")
def paged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the customers, read in the order of a cursor over page files of forty each."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = customers.count()
    number = ordered.numbered(customers, "c_custkey", "k").withColumn("page", F.floor((F.col("k") - 1) / 40))
    token = lambda k: F.when(k == 0, pages.FIRST).otherwise(F.md5(k.cast("string")))
    last = (n - 1) // 40
    each = number.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("studies"))
    made = each.select(token(F.col("page")).alias("token"), "studies", F.when(F.col("page") < last, token(F.col("page") + 1)).alias("nextPageToken"))
    path = shared_path(spark, "pages")
    made.write.partitionBy("token").option("maxRecordsPerFile", 1).json(path)
    raw = spark.read.schema("studies array<struct<c_custkey:bigint,c_name:string>>, nextPageToken string, token string").option("basePath", path).json(path)
    stored = raw.select("token", F.col("nextPageToken").alias("next_token"), F.col("studies").alias("records"))
    return pages.scan(stored, n * 3 // 4).select("pos", "place", "record.c_custkey", "record.c_name")


@query("""WITH r AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(o_orderkey AS VARCHAR), chr(0)), coalesce(CAST(o_custkey AS VARCHAR), chr(0)), coalesce(o_orderstatus, chr(0)), coalesce(o_orderpriority, chr(0)))) AS h FROM orders),
e AS (SELECT h, count(*) AS n FROM r GROUP BY h), l2 AS (SELECT h[:2] AS p, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS d, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1),
l1 AS (SELECT p[:1] AS p, sha256(string_agg(d || ':' || n, ',' ORDER BY p)) AS d, CAST(sum(n) AS BIGINT) AS n FROM l2 GROUP BY 1), l0 AS (SELECT '' AS p, sha256(string_agg(d || ':' || n, ',' ORDER BY p)) AS d, CAST(sum(n) AS BIGINT) AS n FROM l1)
SELECT 2 AS level, p AS prefix, n, d AS digest FROM l2 UNION ALL SELECT 1, p, n, d FROM l1 UNION ALL SELECT 0, p, n, d FROM l0""")
def order_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of the orders."""
    return digests.tree(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", depth=2)


@query(r"""WITH i AS (SELECT conv_id, turn, sha256('reader' || chr(0) || coalesce(text, '')) AS key, CASE WHEN text LIKE '%?%' THEN 'question' ELSE CAST(length(text) AS VARCHAR) END AS answer FROM conversations),
a AS (SELECT key FROM i WHERE turn = 0 GROUP BY key) SELECT i.conv_id, i.turn, i.key, i.answer, true AS has_answer, a.key IS NOT NULL AS in_first_run FROM i LEFT JOIN a USING (key)""")
def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's answers to every turn, of two runs over one store: the second asks for what the first, over first turns, has not."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", cells.cache_key(F.lit("reader"), F.col("text")).alias("key"))
    store = answers.AnswerStore(spark, shared_path(spark, "answers"))
    reader = lambda rows: rows.select("key", F.when(F.col("text").contains("?"), "question").otherwise(F.length("text").cast("string")).alias("answer"))
    store.ask(turns.where("turn = 0"), reader)
    before = written(store.answers().select("key", F.lit(True).alias("seen")), "first-run")
    store.ask(turns, reader)
    both = store.answered(turns).join(before, "key", "left")
    return both.select("conv_id", "turn", "key", "answer", "has_answer", F.coalesce("seen", F.lit(False)).alias("in_first_run"))


# Generated sets: their atoms are those of the study texts made of the table part, their size follows the customers.


def _pool(spark: SparkSession, sf_dir: str) -> list[list[dict]]:
    found = written(segmentation.with_atoms(_different(spark, sf_dir)), "atoms").where("hit IS NOT NULL")
    return generation.pool_of(found.select("hit.tree"))


def _per_level(spark: SparkSession, sf_dir: str) -> int:
    return max(20, _table(spark, sf_dir, "customer").count() // 10)


def _shapes(made: DataFrame) -> DataFrame:
    return made.select("level", "number", "gold", logic.structure(F.col("tree")).alias("s")).select("level", "number", "gold", "s.*")


@query()
def matched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated items of 14 leaves at depths 2 to 6, half of them met, with their structure."""
    return _shapes(generation.size_matched(spark, _pool(spark, sf_dir), list(range(2, 7)), _per_level(spark, sf_dir)))


@query("""WITH n AS (SELECT greatest(20, count(*) // 10) AS n FROM customer) SELECT v.level, gold, CASE WHEN gold THEN n // 2 ELSE n - n // 2 END AS n, 14 AS leaves, 6 AS groups, 4 AS nots, v.level AS depth FROM n, (VALUES (2), (3), (4), (5), (6)) v(level), (VALUES (true), (false)) g(gold)""")
def matched_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matched_items must give by design: quotas filled, one structure a depth."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return matched_items(spark, sf_dir).groupBy("level", "gold").agg(F.count(F.lit(1)).alias("n"), *map(one, ("leaves", "groups", "nots", "depth")))


@query()
def depth_ladder_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated items of freely drawn trees of depths 2 to 4, half of them met."""
    return _shapes(generation.depth_ladder(spark, _pool(spark, sf_dir), [2, 3, 4], _per_level(spark, sf_dir)))


@query()
def size_sweep_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated items of depth 3 and 7 to 112 leaves (as many as there are atoms, at most), half of them met."""
    pool = _pool(spark, sf_dir)
    return _shapes(generation.size_sweep(spark, pool, [n for n in (7, 14, 28, 56, 112) if n <= len(pool)], _per_level(spark, sf_dir) // 5))
