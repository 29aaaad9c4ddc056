"""Checks of tables: duplicates, drift, leakage, coverage, gold, structure.

Each returns the offending rows, so an empty result is a pass and the check scales like a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic


def duplicate_ids(df: DataFrame, ident: str) -> DataFrame:
    """Ids that occur more than once, with how often."""
    return df.groupBy(F.col(ident).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def versions(df: DataFrame, column: str) -> DataFrame:
    """The distinct versions; more than one is drift."""
    return df.select(F.col(column).alias("version")).distinct()


def leaked(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Keys on both sides of a split."""
    return train.select(column).intersect(test.select(column))


def coverage(items: DataFrame, predictions: DataFrame, ident: str = "item_id") -> DataFrame:
    """id and side: `missing` has no prediction, `extra` no item."""
    need, have = items.select(F.col(ident).alias("id")).distinct(), predictions.select(F.col(ident).alias("id")).distinct()
    return need.join(have, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(need, "id", "left_anti").withColumn("side", F.lit("extra")))


def gold_mismatches(stored: DataFrame, regenerated: DataFrame, ident: str = "item_id") -> DataFrame:
    """Items whose stored gold isn't the one found again."""
    return stored.select(ident, F.col("gold").alias("stored")).join(regenerated.select(ident, F.col("gold").alias("found")), ident).where(~F.col("stored").eqNullSafe(F.col("found")))


def rejected_trees(df: DataFrame, ident: str, tree: Column) -> DataFrame:
    """id and reason: one row for each constraint that a tree breaks."""
    return df.select(F.col(ident).alias("id"), F.explode(logic.violations(tree)).alias("reason"))


def rejected_predictions(predictions: DataFrame) -> DataFrame:
    """item_id and reason of predictions that can't be scored: no id, no label, a confidence outside 0 to 1, an id used twice."""
    rules = F.array_compact(F.array(
        F.when(F.trim(F.coalesce(F.col("item_id"), F.lit(""))) == "", "no_item_id"), F.when(F.col("label").isNull(), "no_label"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence_out_of_range"),
    ))
    rows = predictions.select("item_id", F.explode(rules).alias("reason"))
    return rows.unionByName(duplicate_ids(predictions.where("item_id IS NOT NULL"), "item_id").select(F.col("id").alias("item_id"), F.lit("duplicate_item_id").alias("reason")))


def figures(text: Column, pattern: str) -> Column:
    """All numbers that a report states after a label: group 1 of a pattern, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))


def misstated(claims: DataFrame, recomputed: DataFrame, on: list[str], tolerance: float = 0.0006) -> DataFrame:
    """Claims (on, claimed) whose recomputed value is missing or differs by more than the tolerance."""
    both = claims.join(recomputed.select(*on, "value"), on, "left")
    return both.where(F.col("value").isNull() | (F.abs(F.col("claimed") - F.col("value")) > tolerance))
