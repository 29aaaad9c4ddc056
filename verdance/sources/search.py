"""Free-text search over cached studies: an inverted index in Parquet, ranked by BM25.

The index is a folder. `postings` has a row for each term of each study (term, study_id, tf, the study's length), written in order of
term, so the row groups' statistics leave few to be read for a search; a term that most studies have
is spread over as many files as its rows need. `studies` has the ids and lengths, written last: a segment
counts once its studies are there, so a run that was broken off leaves nothing that is read, and repeating it
adds what lacks. Adding studies writes another segment and reads only the ids of the others.

A search takes the postings of the queries' terms, deals them out by study, meets the queries there and adds up by query and study
without another shuffle, and ranks by a window that takes k rows a task and query at most. So what is shuffled is
a posting once, not once for each query that has its term. Scores are whole millionths of BM25 added up term by term, so equal
studies tie exactly whatever the order of addition; ties go by id.

Defined cases: words are runs of letters and digits in lower case; null texts have none; a study without
words is indexed and never found; a repeated id is indexed once (its least text); a query
without words finds nothing; a word that is repeated in a query counts once; with need='all' a study must have every
word of the query, so a word that no study has finds nothing."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stages import written

WORD = r"[\p{L}\p{N}]+"
#: Saturation of repeated words, and how much a study's length counts.
K1, B = 1.2, 0.75
SCALE = 1_000_000
#: Up to so many words of a search go to the scan as a filter.
PUSHED = 1000
#: Up to so many words of all queries (a word counts for each query that has it) go to the tasks by broadcast.
MOST_ASKED = 1_000_000
#: Sums, one for each study and query, that a task has.
SUMS_A_TASK = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def impact(tf: Column, length: Column, mean: Column, weight: Column) -> Column:
    """A term's part of a score, in whole millionths."""
    return F.floor(weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) * SCALE).cast("long")


class Index:
    """The index at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def studies(self) -> DataFrame:
        """study_id, length and segment of the indexed studies."""
        try:
            return self.spark.read.schema("study_id string, length long, segment string").parquet(f"{self.path}/studies")
        except AnalysisException:  # nothing written there so far
            return self.spark.createDataFrame([], "study_id string, length long, segment string")

    def segments(self) -> list[str]:
        return sorted(r["segment"] for r in self.studies().select("segment").distinct().collect())

    def postings(self) -> DataFrame:
        """term, study_id, tf and the study's length of the finished segments."""
        paths = [f"{self.path}/postings/{s}" for s in self.segments()]
        schema = "term string, study_id string, tf long, length long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, studies: DataFrame, ident: str = "study_id", *fields: str) -> str:
        """Indexes the fields (text, if none is named) of the studies whose id isn't indexed yet; returns the segment's name."""
        segment = uuid.uuid4().hex
        body = F.concat_ws("\n", *(F.col(c) for c in fields or ("text",)))
        rows = studies.where(F.col(ident).isNotNull()).groupBy(F.col(ident).cast("string").alias("study_id")).agg(F.min(body).alias("body"))
        fresh = rows.join(self.studies().select("study_id"), "study_id", "left_anti").select("study_id", words(F.col("body")).alias("w"))
        # Texts are shuffled once; a study without words has one row, without a term.
        each = fresh.select("study_id", F.size("w").cast("long").alias("length"), F.explode_outer("w").alias("term"))
        counted = written(each.groupBy("study_id", "length", "term").agg(F.count("term").alias("tf")), "postings")
        found = counted.where("term IS NOT NULL").select("term", "study_id", "tf", "length")
        found.repartitionByRange("term", "study_id").sortWithinPartitions("term", "study_id").write.parquet(f"{self.path}/postings/{segment}")
        counted.select("study_id", "length").distinct().withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.path}/studies")
        return segment

    def compact(self, target: str) -> Index:
        """A copy of the index at another path, in one segment."""
        out, segment = Index(self.spark, target), uuid.uuid4().hex
        self.postings().repartitionByRange("term", "study_id").sortWithinPartitions("term", "study_id").write.parquet(f"{out.path}/postings/{segment}")
        self.studies().withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{out.path}/studies")
        return out

    def search_all(self, queries: DataFrame, k: int = 20, need: str = "any") -> DataFrame:
        """query_id, rank, study_id and score (millionths) of the k best studies of each of queries (query_id, text)."""
        asked = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("w")).where(F.size("w") > 0)
        asked = asked.select("query_id", F.size("w").alias("n_words"), F.explode("w").alias("term"))
        return self._ranked(asked, self.postings(), k, need)

    def search(self, text: str, k: int = 20, need: str = "all") -> DataFrame:
        """rank, study_id and score of the k best studies for one text; its words are a filter of the scan."""
        one = self.spark.createDataFrame([(text,)], "text string").select(F.array_distinct(words(F.col("text"))).alias("w"))
        terms = one.collect()[0]["w"]
        asked = self.spark.createDataFrame([(0, len(terms), t) for t in terms], "query_id int, n_words int, term string")
        found = self.postings()
        if len(terms) <= PUSHED:
            found = found.where(F.col("term").isin(terms))
        return self._ranked(asked, found, k, need).drop("query_id")

    def _ranked(self, asked: DataFrame, postings: DataFrame, k: int, need: str) -> DataFrame:
        if need not in ("any", "all"):
            raise ValueError("need is any or all")
        all_ = self.studies().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).collect()[0]
        n, mean = F.lit(all_["n"]).cast("double"), F.lit(all_["mean"] or 1.0)
        asked = written(asked, "asked")
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries")).collect()[0]
        met = postings.join(asked.select("term").distinct(), "term", "left_semi")
        weights = met.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(n, F.col("df").cast("double")).alias("weight"))
        parts = met.join(written(weights, "weights"), "term").select("study_id", "term", impact(F.col("tf"), F.col("length"), mean, F.col("weight")).alias("part"))
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-all_["n"] * size["queries"] // SUMS_A_TASK))
        few = F.broadcast(asked) if size["n"] <= MOST_ASKED else asked
        scored = parts.repartition(tasks, "study_id").join(few, "term")
        total = scored.groupBy("query_id", "study_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("met"), F.first("n_words").alias("n_words"))
        if need == "all":
            total = total.where("met = n_words")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "study_id"))
        return total.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "study_id", "score")
