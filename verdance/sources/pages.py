"""Paged scans: records that come in pages, each naming the next one by a token, read in that order up to a limit.

The pages are a table (token, next_token, records), as a fetch has stored them; which of them the cursor passes, and in what
order, is found without walking it: in round k every page knows the page 2**k further on, so the pages known so far, 2**k from
the start, reach as many again. A million pages take twenty rounds of joins on tokens. Running sums of the pages' sizes say where the limit cuts.

Defined cases: a page that isn't there, a null token or one that leads back to a page already passed ends the scan; so does a page without records; pages
that no cursor reaches don't count; of pages with equal tokens the one of the least content counts; a limit of 0 gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from ..plans.stages import written

FIRST = "first"


def read_pages(spark: SparkSession, path: str, record: str) -> DataFrame:
    """token, next_token and records of a folder of page files <token>.json ({"studies": [...], "nextPageToken": ...}); record: the type of a study. A corrupt file fails the read."""
    raw = spark.read.schema(f"studies array<{record}>, nextPageToken string").option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    token = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))
    return raw.select(token.alias("token"), F.col("nextPageToken").alias("next_token"), F.col("studies").alias("records"))


def page_order(pages: DataFrame, first: str = FIRST) -> DataFrame:
    """token and pos (0, 1, ...) of the pages that the cursor passes from `first` on. pages: token (unique) and next_token."""
    jump = written(pages.where("token IS NOT NULL AND next_token IS NOT NULL").select("token", F.col("next_token").alias("far")), "page-jumps")
    there = pages.select("token")
    passed = written(there.where(F.col("token") == first).select("token", F.lit(0).cast("long").alias("pos")), "page-order")
    step = 1
    while True:
        reached = passed.join(jump, "token").select(F.col("far").alias("token"), (F.col("pos") + step).alias("pos")).join(there, "token", "left_semi")
        fresh = written(reached.groupBy("token").agg(F.min("pos").alias("pos")).join(passed.select("token"), "token", "left_anti"), "page-fresh")
        if not fresh.limit(1).count():
            return passed
        passed = written(passed.unionByName(fresh), "page-order")
        jump = written(jump.join(jump.select(F.col("token").alias("far"), F.col("far").alias("further")), "far").select("token", F.col("further").alias("far")), "page-jumps")
        step *= 2


def scan(pages: DataFrame, limit: int | None = None, first: str = FIRST) -> DataFrame:
    """pos, place (within the page) and record of the records in the order of the cursor, `limit` of them at most (the caller's budget)."""
    one = pages.where("token IS NOT NULL").groupBy("token").agg(F.min(F.struct("next_token", F.coalesce(F.size("records"), F.lit(0)).alias("n"), F.xxhash64("records").alias("h"))).alias("p"))
    slim = written(one.select("token", "p.next_token", F.greatest("p.n", F.lit(0)).cast("long").alias("n"), "p.h"), "pages")
    order = page_order(slim.select("token", "next_token"), first).join(slim, "token")
    order = written(order, "pages-passed")
    end = order.where("n = 0").agg(F.min("pos").alias("end")).collect()[0]["end"]
    full = order if end is None else order.where(F.col("pos") < end)
    sums = running_sums(full.select("pos", "n", "token", "next_token", "h"), [], "pos", {"upto": "n"})
    before = F.col("upto") - F.col("n")
    taken = F.col("n") if limit is None else F.least(F.col("n"), F.lit(limit) - before)
    wanted = sums.withColumn("take", taken.cast("int")).where("take > 0")
    same = (F.col("p.token") == F.col("w.token")) & F.col("p.next_token").eqNullSafe(F.col("w.next_token")) & (F.xxhash64("p.records") == F.col("w.h"))
    rows = pages.dropDuplicates(["token", "next_token", "records"]).alias("p").join(wanted.alias("w"), same)
    return rows.select("w.pos", F.posexplode(F.slice("p.records", F.lit(1), F.col("w.take"))).alias("place", "record"))
