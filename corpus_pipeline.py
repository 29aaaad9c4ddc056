"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, so stages can be left out or run alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import bpe, decontaminate, language, linededup, neardup
from verdance.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those whose language the network can't tell.

    Equal texts share one fate; with no labelled row every text with a letter stays; an empty table stays empty."""
    return language.reject(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; documents of nothing else go. Null and empty texts stay; of places that
    tie the least (doc_id, text hash, line) is first, rows equal in both are one; an empty table stays empty."""
    return linededup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, of repeated rows one. Null texts stay, empty ones are copies
    of each other; an empty table stays empty."""
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the table benchmark. Null and empty texts contain none, null and empty
    items are in none; repeated rows share one fate; with either table empty nothing goes."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids (binary: little-endian unsigned 32-bit), their number, and whether they decode to the text."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    same = F.coalesce(F.col("bpe_decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select("doc_id", "lang", "source", "bpe_n_tokens", "bpe_ids", same.alias("bpe_restored"))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode_bpe),
]

#: SQL can express neither the network nor the signatures; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
