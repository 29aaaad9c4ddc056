"""Study records: the query that selects them, the cache they are read from, and the pool they give.

There is no network here. StudyQuery states and checks a request; `top_up` and `read_through` take the
records that a fetch brought as a DataFrame."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..operators import digests

#: The fields of a record that are read; all may be missing.
STUDY = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,"
    "statusModule:struct<studyFirstPostDateStruct:struct<date:string,type:string>>,"
    "designModule:struct<studyType:string,phases:array<string>>,eligibilityModule:struct<eligibilityCriteria:string>>"
)
MANIFEST = "n_studies_cached long, first_posted_from string, first_posted_to string, snapshot_id string, extractor_version string, pages_fetched long, fields array<string>, query_params map<string,string>, fetched_utc timestamp"
IDENT = r"\ANCT[0-9]{8}\z"


@dataclass(frozen=True)
class StudyQuery:
    """Which studies to ask for; a query without any filter, or a page size outside 1 to 1000, is refused."""

    phases: tuple[str, ...] = ()
    study_type: str | None = None
    statuses: tuple[str, ...] = ()
    posted_from: str | None = None
    posted_to: str | None = None
    page_size: int = 100
    fields: tuple[str, ...] = field(default=("NCTId", "BriefTitle", "StudyFirstPostDate", "StudyType", "Phase", "EligibilityCriteria"))

    def __post_init__(self) -> None:
        if not (self.phases or self.study_type or self.statuses or self.posted_from or self.posted_to):
            raise ValueError("a study query needs a filter")
        if not 1 <= self.page_size <= 1000:
            raise ValueError("page size lies between 1 and 1000")

    def condition(self) -> Column:
        """The same filter over study rows (see `flat`), for caches and tests."""
        c = F.lit(True)
        if self.phases:
            c = c & F.arrays_overlap("phases", F.array(*map(F.lit, self.phases)))
        if self.study_type:
            c = c & (F.col("study_type") == self.study_type)
        if self.statuses:
            c = c & F.col("status").isin(*self.statuses)
        if self.posted_from:
            c = c & (F.col("first_posted") >= self.posted_from)
        if self.posted_to:
            c = c & (F.col("first_posted") <= self.posted_to)
        return F.coalesce(c, F.lit(False))


def valid_ident(ident: Column) -> Column:
    return F.coalesce(F.rlike(ident, F.lit(IDENT)), F.lit(False))


def flat(raw: DataFrame) -> DataFrame:
    """study_id, title, first_posted, study_type, phases and text of raw records."""
    p = "protocolSection."
    return raw.select(
        F.col(p + "identificationModule.nctId").alias("study_id"), F.col(p + "identificationModule.briefTitle").alias("title"), F.col(p + "statusModule.studyFirstPostDateStruct.date").alias("first_posted"),
        F.col(p + "designModule.studyType").alias("study_type"), F.col(p + "designModule.phases").alias("phases"), F.col(p + "eligibilityModule.eligibilityCriteria").alias("text"),
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """flat() of a folder of JSON files NCT*.json, one record each; a corrupt file fails the read, other names are passed over."""
    raw = spark.read.schema(STUDY).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "NCT*.json").json(path)
    named = raw.withColumn("__f", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))
    return flat(named.where(valid_ident(F.col("__f"))))


def write_cache(studies: DataFrame, path: str) -> None:
    """Appends the studies with a valid id, once each, that the Parquet folder at `path` doesn't hold yet, so a repeated run adds nothing."""
    spark = studies.sparkSession
    try:
        fresh = top_up(spark.read.schema(studies.schema).parquet(path), studies)
    except AnalysisException:  # nothing written there so far
        fresh = studies.where(valid_ident(F.col("study_id"))).dropDuplicates(["study_id"])
    fresh.write.mode("append").parquet(path)


def one_study(cached: DataFrame, ident: str) -> DataFrame:
    """The cached record of an identifier; one that isn't an identifier is an error."""
    if not re.fullmatch(r"NCT[0-9]{8}", ident):
        raise ValueError(f"{ident!r} is no study identifier")
    return cached.where(F.col("study_id") == ident)


def top_up(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """The fetched studies, once each, that the cache has not."""
    fresh = fetched.where(valid_ident(F.col("study_id"))).dropDuplicates(["study_id"])
    return fresh.join(cached.select("study_id"), "study_id", "left_anti")


def read_through(wanted: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """study_id and text of wanted ids: the cache's, else the fetched one; ids that neither has drop out."""
    both = wanted.select("study_id").distinct().join(cached.select("study_id", F.col("text").alias("c")), "study_id", "left").join(fetched.select("study_id", F.col("text").alias("f")), "study_id", "left")
    return both.select("study_id", F.coalesce("c", "f").alias("text")).where("text IS NOT NULL")


def manifest(studies: DataFrame, query: StudyQuery, snapshot: str, extractor: str = "1", pages: int | None = None) -> DataFrame:
    """One row that says what a cache holds and how it was asked for."""
    asked = {k: str(v) for k, v in asdict(query).items() if k != "fields" and v}
    one = studies.agg(F.count(F.lit(1)).alias("n_studies_cached"), F.min("first_posted").alias("first_posted_from"), F.max("first_posted").alias("first_posted_to"))
    return one.select("*", F.lit(snapshot).alias("snapshot_id"), F.lit(extractor).alias("extractor_version"), F.lit(pages).cast("long").alias("pages_fetched"), F.array(*map(F.lit, query.fields)).alias("fields"), F.create_map(*(F.lit(x) for kv in sorted(asked.items()) for x in kv)).alias("query_params"), F.current_timestamp().alias("fetched_utc"))


def write_manifest(one: DataFrame, path: str) -> None:
    one.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The row that write_manifest() wrote; a missing or empty manifest is an error."""
    df = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    if df.limit(2).count() != 1:
        raise ValueError(f"{path}: a manifest has one row")
    return df


def write_pool(pool: DataFrame, path: str) -> str:
    """Writes a pool of atoms as Parquet and returns the digest of its content."""
    pool.write.mode("overwrite").parquet(path)
    return pool_digest(pool.sparkSession.read.schema(pool.schema).parquet(path)).collect()[0]["digest"]


def pool_digest(pool: DataFrame) -> DataFrame:
    """One row: n, levels and the root of the digest tree of the pool's content, whatever its files and order (operators.digests)."""
    rows = pool.select("key", "study_id", "sentence", logic.key(F.col("hit.tree")).alias("tree"))
    return digests.root(rows, "key", "study_id", "sentence", "tree")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """A pool of atoms; an empty or missing one, or one with an unsound tree, is an error."""
    pool = spark.read.parquet(path)
    bad = pool.where(F.size(logic.violations(F.col("hit.tree"))) > 0).limit(1).count()
    if bad or not pool.limit(1).count():
        raise ValueError(f"{path}: the pool is empty or has unsound atoms")
    return pool
