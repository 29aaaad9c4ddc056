"""Decisions against gold: accuracy, F1, intervals, calibration, selective accuracy.

Rows are decisions: gold boolean, predicted boolean, confidence double and whatever columns the
caller groups by. Every score is one aggregation with map-side partial sums; a group and the whole
come out of one pass by GROUPING SETS. Rows without gold or prediction don't count.

Defined cases: a score of no rows is 0, and its interval (0, 0); a null group is `ungrouped`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import share, wilson
from ..plans.skew import frequent_join
from ..plans.stages import written
from .ordered import running_sums
from .validation import coverage

OVERALL, UNGROUPED = "overall", "ungrouped"


def decisions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """items joined with predictions on item_id. What either side lacks drops out: validation.coverage lists it."""
    return items.join(predictions, "item_id")


def covered(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """decisions() of a complete submission: fails if an item has no prediction or a prediction no item."""
    gaps = coverage(items, predictions).groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()
    if gaps:
        raise ValueError("; ".join(f"{r['n']} {r['side']}" for r in gaps))
    return decisions(items, predictions)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def known(rows: DataFrame) -> DataFrame:
    return rows.where("gold IS NOT NULL AND predicted IS NOT NULL")


def group_scores(rows: DataFrame, group: str) -> DataFrame:
    """grp, n, n_correct, accuracy, low, high, gold_rate of each group and of all rows (grp `overall`)."""
    slim = known(rows).select(F.coalesce(F.col(group).cast("string"), F.lit(UNGROUPED)).alias("grp"), "gold", "predicted")
    by = slim.groupingSets([[F.col("grp")], []], F.col("grp")).agg(
        F.grouping("grp").alias("whole"), F.count(F.lit(1)).alias("n"), _count(F.col("gold") == F.col("predicted")).alias("n_correct"), _count(F.col("gold")).alias("n_gold"))
    out = by.where("n > 0").withColumn("w", wilson(F.col("n_correct"), F.col("n")))
    return out.select(
        F.when(F.col("whole") == 1, OVERALL).otherwise(F.col("grp")).alias("grp"), "n", "n_correct",
        share(F.col("n_correct"), F.col("n")).alias("accuracy"), F.col("w.low").alias("low"), F.col("w.high").alias("high"), share(F.col("n_gold"), F.col("n")).alias("gold_rate"),
    )


def class_scores(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall and f1 of each label that gold or predicted has."""
    melted = known(rows).select(F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("label"), "gold", "predicted")
    by = melted.groupBy("label").agg(
        _count((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label"))).alias("tp"),
        _count((F.col("gold") != F.col("label")) & (F.col("predicted") == F.col("label"))).alias("fp"),
        _count((F.col("gold") == F.col("label")) & (F.col("predicted") != F.col("label"))).alias("fn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return by.select(F.col("label").cast("string").alias("label"), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def headline(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy, micro_f1 (both classes pooled, so accuracy), macro_f1 (over labels that occur),
    macro_f1_both (over both labels always) and balanced_accuracy (NULL if a class is missing)."""
    g, p = F.col("gold"), F.col("predicted")
    one = known(rows).agg(
        F.count(F.lit(1)).alias("n"), _count(g & p).alias("tp"), _count(~g & p).alias("fp"), _count(g & ~p).alias("fn"), _count(~g & ~p).alias("tn"))
    f_true = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    f_false = F.when(F.col("tn") > 0, 2 * F.col("tn") / (2 * F.col("tn") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    wrong = F.col("fp") + F.col("fn")
    classes = (F.col("tp") + wrong > 0).cast("int") + (F.col("tn") + wrong > 0).cast("int")
    accuracy = share(F.col("tp") + F.col("tn"), F.col("n"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    balanced = F.when((pos > 0) & (neg > 0), (F.col("tp") / F.nullif(pos, F.lit(0)) + F.col("tn") / F.nullif(neg, F.lit(0))) / 2)
    return one.select("n", accuracy.alias("accuracy"), accuracy.alias("micro_f1"), F.when(classes > 0, (f_true + f_false) / classes).otherwise(0.0).alias("macro_f1"), ((f_true + f_false) / 2).alias("macro_f1_both"), balanced.alias("balanced_accuracy"))


def subset_scores(rows: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Scores of nested or overlapping subsets in one pass: subset, n, n_correct, accuracy, low and high."""
    flags = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in subsets.items()))
    by = known(rows).select(F.explode(F.array_compact(flags)).alias("subset"), (F.col("gold") == F.col("predicted")).alias("ok")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), _count(F.col("ok")).alias("n_correct"))
    return by.withColumn("w", wilson(F.col("n_correct"), F.col("n"))).select("subset", "n", "n_correct", share(F.col("n_correct"), F.col("n")).alias("accuracy"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Equal-width bins (low, high]; 0 joins the first."""
    return F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)).cast("int")


def calibration_bins(rows: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """by, bin, n, mean confidence and accuracy of each bin that has rows."""
    ok = (F.col("gold") == F.col("predicted")).cast("double")
    return known(rows).withColumn("bin", bin_of(F.col("confidence"), bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(ok).alias("accuracy"))


def calibration(rows: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """by, n, ece, n_confidences and degenerate (at most one confidence, to 12 decimals)."""
    ok = (F.col("gold") == F.col("predicted")).cast("double")
    slim = known(rows).select(*by, bin_of(F.col("confidence"), bins).alias("bin"), F.round("confidence", 12).alias("c"), "confidence", ok.alias("ok"))
    level = slim.groupBy(*by, "bin", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sc"), F.sum("ok").alias("so"))
    per_bin = level.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("sc").alias("sc"), F.sum("so").alias("so"), F.count(F.lit(1)).alias("k"))
    gap = F.sum(F.abs(F.col("so") - F.col("sc")))
    return per_bin.groupBy(*by).agg(F.sum("n").alias("n"), (gap / F.sum("n")).alias("ece"), F.sum("k").alias("n_confidences"), (F.sum("k") <= 1).alias("degenerate"))


def selective_accuracy(rows: DataFrame, *by: str, coverages: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """by, coverage (percent), k and accuracy of the k most confident rows; a tie at the boundary counts in expectation.

    Rows are first summed by confidence; running sums over ranges of confidence find each group's boundary (ordered.running_sums)."""
    level = known(rows).groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("n"), _count(F.col("gold") == F.col("predicted")).alias("ok"))
    level = written(level, "confidences")
    totals = level.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("__levels"))
    run = running_sums(level, list(by), "confidence", {"n_upto": "n", "ok_upto": "ok"}, falling=True)
    run = _with_totals(run, totals, list(by))
    wanted = F.array(*(F.struct(F.lit(round(c * 100)).alias("coverage"), F.lit(c).alias("c")) for c in coverages))
    cut = run.select("*", F.explode(wanted).alias("w")).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("total") * F.col("w.c"), 0)).cast("long"))
    at = cut.where((F.col("n_upto") >= F.col("k")) & (F.col("n_upto") - F.col("n") < F.col("k")))
    above, need = F.col("ok_upto") - F.col("ok"), F.col("k") - (F.col("n_upto") - F.col("n"))
    return at.select(*by, F.col("w.coverage").alias("coverage"), "k", ((above + need * F.col("ok") / F.col("n")) / F.col("k")).alias("accuracy"))


def _with_totals(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """rows with `total` of their group; a null group is one, too."""
    if not by:
        return rows.withColumn("total", F.lit(totals.collect()[0]["total"]))
    named = totals.select(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")).alias(f"__{c}") for c in by), "total", "__levels")
    keyed = rows.select("*", *(F.coalesce(F.to_json(F.struct(c)), F.lit("")).alias(f"__{c}") for c in by))
    keys = [f"__{c}" for c in by]
    return frequent_join(keyed, named, keys, "__levels").drop("__levels", *keys)


def ranked(board: DataFrame, metric: str, order: str, limit: int | None = None) -> DataFrame:
    """A leaderboard: best metric first, ties in order of `order`; limit is the feature of a top-k report."""
    out = board.orderBy(F.desc(metric), F.asc(order))
    return out.limit(limit) if limit else out
