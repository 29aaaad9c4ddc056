"""Streaming versions of two batch jobs over events: an extension, with the same expressions.

State is bounded: windows close behind the watermark, and duplicates are known within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, gold: Column, predicted: Column, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, n and n_correct of each window of event time; events later than the watermark are left out."""
    rows = events.withWatermark("ts", late).select("ts", (gold == predicted).alias("ok"))
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct")).select(F.col("w.start").alias("start"), "n", "n_correct")


def once(events: DataFrame, ident: str, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def facts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, user_id, entity, value (of the latest event) and last_ts: the facts of each user by window."""
    rows = events.withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", width).alias("w"), "user_id", F.col("event_type").alias("entity")).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("last_ts"))
    return by.select(F.col("w.start").alias("start"), "user_id", "entity", "value", "last_ts")
