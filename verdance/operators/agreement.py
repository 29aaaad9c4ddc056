"""Two annotators: kappa, agreement by slice, disagreements and their resolution.

Rows are pairs: item_id, a and b (labels), and slices. Labels meet in a confusion table of few cells;
every figure is computed from it, so rows are shuffled once, as partial counts.

Defined cases: kappa of no rows is 0; where chance agreement is total it is NULL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import kappa_of, share

#: Categories of failure.
CATEGORIES = ["negation_polarity", "temporal", "numeric_threshold", "logical_composition", "entity_conflation", "implicit_knowledge", "fabrication", "none"]
#: Categories that no counterfactual over a form can establish.
#: Categories that only people give.
HUMAN_ONLY = ["entity_conflation", "implicit_knowledge", "fabrication"]
MOST_CELLS = 10_000


def aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """item_id, a and b of the items that both label (item_id, category)."""
    return first.select("item_id", F.col("category").alias("a")).join(second.select("item_id", F.col("category").alias("b")), "item_id")


def only(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: how many items both, only the first and only the second label."""
    a, b = first.select("item_id", F.lit(1).alias("in_a")), second.select("item_id", F.lit(1).alias("in_b"))
    return a.join(b, "item_id", "full").agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, *by: str) -> DataFrame:
    """by, n, agreement, expected and kappa."""
    cells = confusion(pairs, *by)
    marks = cells.select(*by, "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("label")), F.struct(F.lit(1).alias("side"), F.col("b").alias("label")))).alias("m"), (F.col("a") == F.col("b")).alias("same"))
    side = lambda k: F.sum(F.when(F.col("m.side") == k, F.col("n")).otherwise(0))
    margins = marks.groupBy(*by, "m.label").agg(side(0).alias("na"), side(1).alias("nb"), F.sum(F.when(F.col("same") & (F.col("m.side") == 0), F.col("n")).otherwise(0)).alias("agree"))
    total = margins.groupBy(*by).agg(F.sum("na").alias("n"), F.sum("agree").alias("agree"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    n = F.col("n").cast("double")
    po, pe = share(F.col("agree"), F.col("n")), F.when(F.col("n") > 0, F.col("products") / (n * n)).otherwise(0.0)
    value = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, 0.0).when(pe < 1 - 1e-12, (po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return total.select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), po.alias("agreement"), pe.alias("expected"), value.alias("kappa"))


def per_category(pairs: DataFrame) -> DataFrame:
    """category, n_a, n_b, n_both, agreement and kappa of each category against the rest, from the confusion table."""
    cells = confusion(pairs)
    total = cells.agg(F.sum("n").alias("total"))
    each = cells.select("n", F.explode(F.array_distinct(F.array("a", "b"))).alias("category"), "a", "b")
    at = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by = each.groupBy("category").agg(at(F.col("a") == F.col("category")).alias("n_a"), at(F.col("b") == F.col("category")).alias("n_b"), at((F.col("a") == F.col("category")) & (F.col("b") == F.col("category"))).alias("n_both")).join(F.broadcast(total))
    n = F.col("total").cast("double")
    po = (n - F.col("n_a") - F.col("n_b") + 2 * F.col("n_both")) / n
    pe = (F.col("n_a") * F.col("n_b") + (n - F.col("n_a")) * (n - F.col("n_b"))) / (n * n)
    return by.select("category", "n_a", "n_b", "n_both", po.alias("agreement"), F.when(pe < 1 - 1e-12, (po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def by_slices(pairs: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """kappa of all rows and of every value of each slice in one pass: slice, value and the columns of kappa."""
    cells = [F.struct(F.lit(name).alias("slice"), c.cast("string").alias("value")) for name, c in slices.items()]
    each = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *cells)).alias("s"))
    return kappa(each.where("s.value IS NOT NULL").select("a", "b", "s.slice", "s.value"), "slice", "value")


def kappa_interval(pairs: DataFrame, replicates: int = 5000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: n, kappa, low, high and n_draws of a percentile bootstrap over items.

    Resampling items is multinomial over confusion cells, so a replicate draws cells, in parallel; draws without kappa drop out."""
    spark = pairs.sparkSession
    rows = confusion(pairs).orderBy("a", "b").limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of labels")
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    a, b = (np.array([names.index(r[c]) for r in rows], int) for c in "ab")
    n = np.array([r["n"] for r in rows], int)

    def of(cells: np.ndarray) -> float:
        total = cells.sum()
        ma, mb = np.bincount(a, cells, len(names)), np.bincount(b, cells, len(names))
        return kappa_of(cells[a == b].sum() / total, float((ma * mb).sum()) / total**2)

    schema = "n long, kappa double, low double, high double, n_draws long"
    if not len(rows):
        return spark.createDataFrame([(0, None, None, None, 0)], schema)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": [of(np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum())) for i in batch["id"]]})

    ks = spark.range(replicates).mapInPandas(drawn, "k double").where(~F.isnan("k"))
    sorted_ = ks.agg(F.array_sort(F.collect_list("k")).alias("ks"))  # `replicates` numbers, whatever the input
    m = F.size("ks")
    low = F.get("ks", F.greatest(F.lit(0), F.floor(m * (alpha / 2)).cast("int") - 1))
    high = F.get("ks", F.least(m - 1, F.floor(m * (1 - alpha / 2)).cast("int")))
    point = of(n)
    return sorted_.select(F.lit(int(n.sum())).cast("long").alias("n"), F.lit(None if np.isnan(point) else float(point)).cast("double").alias("kappa"), low.alias("low"), high.alias("high"), m.cast("long").alias("n_draws"))


def disagreements(pairs: DataFrame, clinical: Column) -> DataFrame:
    """item_id, a, b, clinical and rule of every item on which the labels differ."""
    flag = F.coalesce(clinical, F.lit(False))
    return pairs.where("a <> b").select("item_id", "a", "b", flag.alias("clinical"), F.when(flag, "annotator1_governs").otherwise("resolve_on_merits").alias("rule"))


def consensus(pairs: DataFrame, adjudicated: DataFrame, strict: bool = True) -> DataFrame:
    """item_id and category: the agreed one, else the adjudicated one. strict: an item with neither is an error, else NULL."""
    both = pairs.join(adjudicated.select("item_id", F.col("category").alias("settled")), "item_id", "left")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("settled"))
    if strict:
        value = F.coalesce(value, F.raise_error(F.concat(F.lit("no resolved category for item "), F.col("item_id").cast("string"))).cast("string"))
    return both.select("item_id", value.alias("category"))


def third_signal(human: DataFrame, machine: DataFrame) -> DataFrame:
    """kappa of consensus against automatic labels, and n_impossible: human labels that the machine can't give."""
    pairs = aligned(human, machine)
    return kappa(pairs).join(pairs.agg(F.count_if(F.col("a").isin(*HUMAN_ONLY)).alias("n_impossible")))
