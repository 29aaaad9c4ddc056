"""Order over a whole table without one task that holds it: running sums, ranks, neighbours.

Rows are dealt to tasks by ranges of the order (sampled bounds), so a task has a stretch of it. A first pass sums up each
stretch by group, a window over these sums (a row for each group and stretch) gives what comes before a stretch,
and a window within stretches does the rest. A group of any size is spread over as many stretches as it needs.

Rows that are equal in the order share a sum: all of them count. Callers first add up rows of equal order, so
that no value is more than a row.

Defined cases: an empty table gives no rows; nulls in the order come first (last, where it falls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import frequent_join
from ..plans.stages import written

PART = "__part"


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str], falling: bool = False) -> DataFrame:
    """df with, for each alias -> column of `sums`, the column's sum over the rows of the group up to and with this one.

    df has one row for each group and value of the order."""
    end = F.desc(order) if falling else F.asc(order)
    dealt = written(df.repartitionByRange(*by, end).withColumn(PART, F.spark_partition_id()), "ordered")
    whole = dealt.groupBy(PART, *by).agg(*(F.sum(c).alias(f"__{a}") for a, c in sums.items()))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(PART, *by, *(F.coalesce(F.sum(f"__{a}").over(before), F.lit(0)).alias(f"__{a}") for a in sums))
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (PART, *by)]
    within = Window.partitionBy(PART, *by).orderBy(end).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(F.sum(c).over(within).alias(f"__l_{a}") for a, c in sums.items()))
    met = local.alias("d").join(starts.alias("s"), _all(keys))
    return met.select(*(F.col(f"d.{c}") for c in df.columns), *((F.col(f"d.__l_{a}") + F.col(f"s.__{a}")).alias(a) for a in sums))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def average_ranks(df: DataFrame, column: str, alias: str) -> DataFrame:
    """df with the rank of each value, ties sharing their mean: running sums of the counts by value. Rows with a null value have none and drop out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    place = running_sums(counts, [], column, {"__upto": "__n"})
    ranks = written(place.select(column, "__n", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(alias)), "ranks")
    return frequent_join(df, ranks, [column], "__n").drop("__n")


def numbered(df: DataFrame, order: str, alias: str) -> DataFrame:
    """df (one row for each value of the order) with the number of each row in order, from 1."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), [], order, {alias: "__one"}).drop("__one")


def with_previous(df: DataFrame, order: str, column: str, alias: str) -> DataFrame:
    """df (one row for each value of the order) with the column's value in the row before; NULL in the first."""
    rows = written(numbered(df, order, "__i"), "numbered")
    before = rows.select((F.col("__i") + 1).alias("__i"), F.col(column).alias(alias))
    return rows.join(before, "__i", "left").drop("__i")


#: Ranges of the lower ends that intervals are dealt to, at most.
MOST_RANGES = 4096


def overlapping(df: DataFrame, key: str, low: str, high: str, ranges: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """key_a and key_b (key_a < key_b) of every pair of closed intervals that meet; df is unique on key. Intervals with a null or falling end meet none.
    Columns to be carried come as c_a and c_b, so that pairs, of which there may be many, needn't be joined with df.

    Of two that meet, the one that begins later (in ties the greater key) begins within the other. So lower ends, each in one range
    of the axis, look for the intervals that reach into it: an interval is sent to the ranges it covers, its own lower end to one. Ranges hold
    about equally many lower ends, so what is compared and doesn't meet is a range at most for either end of an interval."""
    rows = df.where(F.col(low) <= F.col(high)).select(F.col(key).alias("k"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    rows = written(rows, "intervals")
    n = rows.count()
    parts = min(MOST_RANGES, ranges or max(1, n // 256))
    cuts = rows.agg(F.percentile_approx("lo", [i / parts for i in range(1, parts)], 100 * parts)).collect()[0][0] if parts > 1 and n else []
    bounds = F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<double>")
    number = lambda c: _position(bounds, len(set(cuts or [])), c)
    own = [f"c{i}" for i in range(len(carried))]
    points = rows.select("k", "lo", *own, number(F.col("lo")).alias("range"))
    spans = rows.select(F.col("k").alias("k2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), *(F.col(c).alias(f"{c}_2") for c in own), F.explode(F.sequence(number(F.col("lo")), number(F.col("hi")))).alias("range"))
    inside = (F.col("lo") <= F.col("hi2")) & ((F.col("lo2") < F.col("lo")) | ((F.col("lo2") == F.col("lo")) & (F.col("k2") < F.col("k"))))
    less = F.col("k") < F.col("k2")
    ends = [e for c, o in zip(carried, own) for e in (F.when(less, F.col(o)).otherwise(F.col(f"{o}_2")).alias(f"{c}_a"), F.when(less, F.col(f"{o}_2")).otherwise(F.col(o)).alias(f"{c}_b"))]
    # Dealt by range, since the intervals are small and their pairs are not; the right side of a merge join is held for each range: the few lower ends, while spans go by.
    return spans.repartition(parts, "range").join(points, "range").where(inside).select(F.least("k", "k2").alias(f"{key}_a"), F.greatest("k", "k2").alias(f"{key}_b"), *ends)


def _position(bounds: Column, n: int, x: Column) -> Column:
    """How many of n sorted bounds are x or less, by halving."""
    further = lambda s: lambda a: F.when((a + s <= n) & (F.get(bounds, a + (s - 1)) <= x), a + s).otherwise(a)  # noqa: E731  a second parameter, even with a default, would be the index
    at = F.lit(0)
    step = 1 << max(0, n.bit_length() - 1)
    while n and step:
        at = _let(at, further(step))
        step >>= 1
    return at


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
