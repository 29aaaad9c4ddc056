"""URL filters: rules on host and path, then a blocked Bloom filter before an exact join.

The list's canonical URLs fill a blocked Bloom filter: a URL's hash names one block of 256 bits and
one bit in each of its eight 32-bit lanes. The filter has a block for every KEYS_EACH URLs. Up to
SENT blocks it goes to every task by broadcast; the larger filter of a longer list is joined by block, blocks of frequent
URLs by broadcast (hot_join). The
possible hits are joined with the list itself, which removes the false positives.

Defined cases: a null URL, or one without `://`, has an empty host and path and no canonical form,
matches no rule and is never listed; repeated rows are judged alike; an empty list blocks nothing;
letters beyond A-Z keep their case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored

#: URLs that share a block of 32 bytes on average, and blocks that are sent by broadcast at most (8 MB).
KEYS_EACH, SENT = 20, 1 << 18
LANES = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., and path without its trailing slash; null if the URL has no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct of the longest fitting rule and its verdict, or null. rules: (verdict, host and path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """Four longs of 64 bits; each lane of 32 bits has one bit set."""
    h = F.xxhash64(url, F.lit(1))
    bit = lambda lane: F.shiftrightunsigned(h, 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    one = F.lit(1).cast("long")
    return F.array(*(F.call_function("shiftleft", one, bit(2 * k)).bitwiseOR(F.call_function("shiftleft", one, bit(2 * k + 1) + 32)) for k in range(LANES // 2)))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filled blocks (block, bits) of a list with a column `canonical`: at most `blocks` rows."""
    m = listed.select(_block(F.col("canonical"), blocks).alias("block"), _mask(F.col("canonical")).alias("m"))
    return m.groupBy("block").agg(*(F.bit_or(F.col("m")[k]).alias(f"w{k}") for k in range(LANES // 2))).select("block", F.array(*(f"w{k}" for k in range(LANES // 2))).alias("bits"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, canonical, rule, listed and verdict of every row of pages.

    listed: any table with a column `url`. A rule decides where one fits; else listed URLs are
    blocked and the rest allowed. The exact join spreads frequent URLs (hot_join)."""
    url = F.col("url")
    known = stored(listed.select(canonical(url).alias("canonical")).where("canonical IS NOT NULL").distinct(), "url-list")
    blocks = max(1, -(-known.count() // KEYS_EACH))
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumns({"block": _block(F.col("canonical"), blocks), "mask": _mask(F.col("canonical"))})
    named, filled = seen.where("canonical IS NOT NULL"), bloom(known, blocks)
    if blocks <= SENT:
        passed = named.join(F.broadcast(filled), "block", "left")
    else:
        rows = named.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        passed = hot_join(named, stored(rows.join(filled, "block"), "url-blocks"), ["block"], "n", "left")
    inside = F.lit(True)
    for k in range(LANES // 2):
        inside = inside & (F.col("bits")[k].bitwiseAND(F.col("mask")[k]) == F.col("mask")[k])
    passed = passed.select("page_id", "host", "path", "canonical", F.coalesce(inside, F.lit(False)).alias("possible"))
    passed = stored(passed.unionByName(seen.where("canonical IS NULL").select("page_id", "host", "path", "canonical", F.lit(False).alias("possible"))), "url-passed")
    frequent = passed.where("possible").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    hits = hot_join(passed.where("possible"), stored(frequent.join(known, "canonical", "left_semi"), "url-hits"), ["canonical"], "n", "left")
    judged = hits.select("page_id", "host", "path", "canonical", F.col("n").isNotNull().alias("listed"))
    judged = judged.unionByName(passed.where("NOT possible").select("page_id", "host", "path", "canonical", F.lit(False).alias("listed")))
    judged = judged.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", "canonical", F.col("fit.rule").alias("rule"), "listed", F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
