"""A digest of a table's content that no order, partitioning or file layout changes, as a tree.

Every row is a SHA-256 of its named columns. Leaves are ranges of that hash, cut at fixed prefixes of hexadecimal
digits, so they hold about as many rows each and are the same however the rows are dealt. A leaf's digest is the SHA-256 of its
distinct rows' hashes in order, each with how often it comes (so a row that is repeated a million times is one
entry); a node's is that of its sixteen children in order. The root tells tables apart, and two trees tell which ranges differ
without the rows being compared.

Defined cases: nulls differ from every value; an empty table's root is the digest of no entry; how deep a tree is follows from the
number of distinct rows alone, and is part of the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import written

#: Distinct rows of a leaf, at most on average.
LEAF = 4096
FIELD, NULL = "\u001f", "\u0000"


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' text forms."""
    return F.sha2(F.concat_ws(FIELD, *(F.coalesce(c.cast("string"), F.lit(NULL)) for c in columns)), 256)


def depth_for(distinct_rows: int) -> int:
    depth = 0
    while distinct_rows > LEAF * 16**depth:
        depth += 1
    return depth


def tree(df: DataFrame, *columns: str, depth: int | None = None) -> DataFrame:
    """level (0: the root), prefix, n (rows below) and digest of every node that has rows; columns: all, if none is named."""
    rows = df.select(row_hash(*(F.col(c) for c in columns or df.columns)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "row-hashes")
    depth = depth_for(rows.count()) if depth is None else depth
    listed = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col("n"), F.col("digest")))), lambda s: F.concat_ws(":", s["digest"], s["n"].cast("string"))), ","), 256)
    entries = rows.select(F.col("h").alias("key"), "n", F.col("h").alias("digest"))
    out = None
    for level in range(depth, -1, -1):
        own = entries.groupBy(F.substring("key", 1, level).alias("prefix")).agg(F.sum("n").alias("n"), listed(F.col("key")).alias("digest"))
        own = written(own.select(F.lit(level).alias("level"), "prefix", "n", "digest"), "digest-level")
        out = own if out is None else out.unionByName(own)
        entries = own.select(F.col("prefix").alias("key"), "n", "digest")
    return out


def root(df: DataFrame, *columns: str, depth: int | None = None) -> DataFrame:
    """One row: n, levels below the root, and digest of the whole table."""
    nodes = tree(df, *columns, depth=depth)
    one = nodes.agg(F.coalesce(F.max(F.when(F.col("level") == 0, F.col("n"))), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("level"), F.lit(0)).alias("levels"), F.max(F.when(F.col("level") == 0, F.col("digest"))).alias("d"))
    return one.select("n", "levels", F.sha2(F.concat_ws(":", F.coalesce("d", F.sha2(F.lit(""), 256)), F.col("levels").cast("string")), 256).alias("digest"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """prefix, n_a and n_b of the leaves in which two trees of equal depth differ."""
    low = lambda t, n: t.where(F.col("level") == t.agg(F.max("level")).collect()[0][0]).select("prefix", F.col("n").alias(f"n_{n}"), F.col("digest").alias(f"d_{n}"))
    both = low(a, "a").join(low(b, "b"), "prefix", "full")
    zero = F.lit(0).cast("long")
    return both.where(~F.col("d_a").eqNullSafe(F.col("d_b"))).select("prefix", F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"))
