"""Answers of a model, kept by key, so that a repeated or broken-off run asks only for what has no answer yet.

A key is a digest of everything that can change the answer (cells.cache_key). Each call that asks writes one segment of
answers, which is seen when it is complete; a run that dies in between leaves nothing that is read. Two runs that ask
for one key at once both write it; readers take the answer of the least segment, so all see the same.

Defined cases: a null key is asked for nobody and has no answer; equal keys in one call are asked once; a null answer (the
model abstains) is kept like any other; an empty store has no answers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, answer string, segment string"


class AnswerStore:
    """The store at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self) -> DataFrame:
        """key and answer, one row a key."""
        try:
            kept = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing written there so far
            kept = self.spark.createDataFrame([], SCHEMA)
        return kept.groupBy("key").agg(F.min(F.struct("segment", "answer")).alias("a")).select("key", "a.answer")

    def open_items(self, items: DataFrame) -> DataFrame:
        """One of the rows of each key of items that has no answer."""
        return items.where("key IS NOT NULL").dropDuplicates(["key"]).join(self.answers().select("key"), "key", "left_anti")

    def ask(self, items: DataFrame, model: Callable[[DataFrame], DataFrame]) -> int:
        """Has the model answer the open items and keeps the answers; returns how many it asked for.

        model: from rows of items to key and answer (string); a column expression or mapInPandas, so it runs where the rows are."""
        segment = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        made = model(self.open_items(items)).select("key", F.col("answer").cast("string").alias("answer"), F.lit(segment).alias("segment"))
        made.write.mode("append").parquet(self.path)
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("segment") == segment).count()

    def answered(self, items: DataFrame) -> DataFrame:
        """items with their answer and whether they have one (a kept null is one)."""
        kept = self.answers().withColumn("has_answer", F.lit(True))
        return items.join(kept, "key", "left").withColumn("has_answer", F.coalesce("has_answer", F.lit(False)))
