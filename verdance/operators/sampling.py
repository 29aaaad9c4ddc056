"""Seeded choice of rows: stratified samples, splits by key, first and top rows of a key.

Order is that of md5(seed:id), which no partitioning changes; it isn't the order of a sequential
generator. Choosing the n least of a table finds the boundary from counts of hash prefixes, so no
task ranks all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3


def shuffled_order(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def least(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows of least order (a hex hash), ties broken arbitrarily.

    Counts of 16**PREFIX prefixes, a bounded table, say which prefixes go whole; only the rows of the one at the boundary are ranked."""
    keyed = df.withColumns({"__o": order, "__p": F.substring(order, 1, PREFIX)})
    counts = keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).orderBy("__p").collect()
    total, edge, rest = 0, None, 0
    for r in counts:
        if total + r["c"] > n:
            edge, rest = r["__p"], n - total
            break
        total += r["c"]
    if edge is None:
        return keyed.drop("__o", "__p")
    whole = keyed.where(F.col("__p") < edge)
    ranked = keyed.where(F.col("__p") == edge).withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__o"))).where(F.col("__r") <= rest).drop("__r")
    return whole.unionByName(ranked).drop("__o", "__p")


def stratified(rows: DataFrame, strata: list[str], ident: str, target: int, seed: int = 11) -> DataFrame:
    """About `target` rows (a sampling operator): of each stratum its proportional share, one at least, and `target` of those at most.

    No share is over `target`, so a task sends the target least rows of a stratum at most and these bounded samples are
    merged: a stratum of any size is never ranked whole. A null stratum is one, too."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    share = F.bround(F.lit(min(target, total)) * F.col("__n") / F.lit(total), 0)
    quota = sizes.select(*(F.col(c).alias(f"__s_{c}") for c in strata), F.greatest(F.lit(1), share).cast("long").alias("__quota"))
    order = shuffled_order(F.col(ident), seed)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("__o"))
    first = rows.withColumn("__o", order).withColumn("__r", place).where(F.col("__r") <= target)
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    picked = first.join(quota, same).where("__r <= __quota").drop("__r", "__quota", "__o", *(f"__s_{c}" for c in strata))
    return least(picked, order, target)


def split_by_key(df: DataFrame, key: str, share: float = 0.2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test): max(1, int(n * share)) of the n distinct keys go to test, with all their rows, so no key is on both sides."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    chosen = least(keys, shuffled_order(F.col(key), seed), max(1, int(n * share)))
    return df.join(chosen, key, "left_anti"), df.join(chosen, key, "left_semi")


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of least order of each key, by an aggregation with map-side partial minima: a frequent key isn't sorted."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def top_per_key(df: DataFrame, key: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each key (a top-k report). Spark filters ranks before the shuffle too, so a frequent key sends k rows a task."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
