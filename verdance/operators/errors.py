"""Why a decision was wrong: counterfactual probes over its tree, and the counts that size the evidence.

Rows: tree, facts, gold, predicted, rationale. A probe evaluates a changed tree and fires on a known
value that equals the wrong prediction; the first that fires names the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic


def category(tree: Column, facts: Column, gold: Column, predicted: Column) -> Column:
    """negation_polarity, temporal, numeric_threshold, logical_composition or none."""
    reproduces = lambda changed: F.coalesce(logic.evaluate(changed, facts) == predicted, F.lit(False))
    return (
        F.when(gold == predicted, "none")
        .when(logic.has_negation(tree) & reproduces(logic.without_negation(tree)), "negation_polarity")
        .when(logic.has_temporal(tree) & reproduces(logic.without_fields(tree, "tmp_")), "temporal")
        .when(logic.has_numeric(tree) & reproduces(logic.without_fields(tree, "num_")), "numeric_threshold")
        .when(logic.depth(tree) >= 1, "logical_composition")
        .otherwise("none")
    )


def labelled(rows: DataFrame, prompt: str | None = "1") -> DataFrame:
    """The wrong decisions with category and unanswerable (of a prompt of version 1 only)."""
    wrong = rows.where("gold <> predicted")
    flag = logic.unanswerable(F.col("tree"), F.col("facts")) if prompt == "1" else F.lit(False)
    return wrong.withColumns({"category": category(F.col("tree"), F.col("facts"), F.col("gold"), F.col("predicted")), "unanswerable": flag})


def breakdown(errors: DataFrame, withhold: bool = True) -> DataFrame:
    """category, n_scored and n_withheld (unanswerable ones, if withhold) of labelled()."""
    held = F.col("unanswerable") & F.lit(withhold)
    return errors.groupBy("category").agg(F.count_if(~held).alias("n_scored"), F.count_if(F.col("unanswerable")).alias("n_withheld"))


def evidence(errors: DataFrame) -> DataFrame:
    """One row: n_errors, n_unanswerable, distinct_rationales and largest_cluster of equal trimmed rationales."""
    reason = F.trim(F.col("rationale"))
    clusters = errors.select(F.when(F.coalesce("rationale", F.lit("")) != "", reason).alias("r"), "unanswerable").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.count_if("unanswerable").alias("u"))
    return clusters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_unanswerable"), F.count("r").alias("distinct_rationales"), F.coalesce(F.max(F.when(F.col("r").isNotNull(), F.col("n"))), F.lit(0)).alias("largest_cluster"))


def pooled(breakdowns: DataFrame) -> DataFrame:
    """Categories summed over runs, with their share."""
    by = breakdowns.groupBy("category").agg(F.sum("n_scored").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("category", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))
