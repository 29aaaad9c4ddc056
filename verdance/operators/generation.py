"""Synthetic items: seeded trees of a given shape, records near their boundaries, quotas of outcomes.

Each item draws from its own generator (seed, level, number), so items are made in parallel and any
partitioning gives the same ones. Gold comes from the evaluator, as a Column. The pool of atoms is a
documented bounded table (MOST_ATOMS) that goes to the tasks with the function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logic
from ..plans.stages import written
from .ordered import running_sums

MOST_ATOMS = 50_000
#: Days by which a window's magnitude is scaled when a recency is drawn, whatever its unit.
WINDOW_DAYS = 30.4375
FACT_LIST = "array<struct<name:string,present:boolean,value:double,days_ago:double,current:boolean>>"
ITEM = f"level int, number long, attempt int, tree {logic.TREE}, facts {FACT_LIST}"


def nested(depth: int, pool: list[list[dict]], rng: np.random.Generator) -> list[dict]:
    """A tree whose branches all reach `depth`: atoms negated with chance 0.25, groups of two or three with 0.15."""
    if depth <= 0:
        leaf = pool[rng.integers(len(pool))]
        return logic.negation(leaf) if rng.random() < 0.25 else leaf
    size = (2, 2, 3)[rng.integers(3)]
    made = logic.group(("and", "or")[rng.integers(2)], *(nested(depth - 1, pool, rng) for _ in range(size)))
    return logic.negation(made) if rng.random() < 0.15 else made


def check_shape(depth: int, leaves: int, groups: int, nots: int) -> None:
    """Whether every tree of `groups` groups over `depth` levels can be given these leaves and negations."""
    if not 1 <= depth <= groups or (depth == 1) != (groups == 1):
        raise ValueError(f"{groups} groups don't fill {depth} levels")
    # All groups but the root may be lowest ones, which need two leaves each; a root alone does, too.
    if leaves < 2 * max(1, groups - 1):
        raise ValueError("too few leaves for the groups")
    if not 0 <= nots <= leaves + groups:
        raise ValueError("more negations than nodes")


def matched(depth: int, pool: list[list[dict]], rng: np.random.Generator, leaves: int = 14, groups: int = 6, nots: int = 4) -> list[dict]:
    """A tree of exactly this depth and these numbers of leaves, groups and negations; operators alternate, so the normal form is as deep.

    The shape is how many groups each level has. A group of one level is an operand of one of the level above, drawn
    evenly; leaves go to groups that lack operands, the rest evenly. Negations are a mask over the postfix array."""
    check_shape(depth, leaves, groups, nots)
    if leaves > len(pool):
        raise ValueError(f"{leaves} leaves of a pool of {len(pool)} atoms")
    per_level = np.ones(depth, int)
    if depth > 1:
        per_level[1:] += rng.multinomial(groups - depth, np.full(depth - 1, 1 / (depth - 1)))
    end = np.cumsum(per_level)
    level = np.repeat(np.arange(depth), per_level)
    within = [int(rng.integers(end[v - 1] - per_level[v - 1], end[v - 1])) for v in level[1:]]
    inner = np.bincount(within, minlength=groups)
    needed = np.maximum(2 - inner, 0)
    atoms = needed + rng.multinomial(leaves - needed.sum(), np.full(groups, 1 / groups))
    flip = int(rng.integers(2))
    # From the lowest level up, each group's operands are put in a drawn order before it; -1 is a leaf.
    operands: list[list[list[int]]] = [[[-1]] * int(n) for n in atoms]
    for g in range(groups - 1, -1, -1):
        postfix = [x for i in rng.permutation(len(operands[g])) for x in operands[g][i]] + [g]
        if g:
            operands[within[g - 1]].append(postfix)
    mask = np.zeros(leaves + groups, bool)
    mask[rng.choice(len(mask), nots, replace=False)] = True
    chosen = iter(rng.choice(len(pool), leaves, replace=False))
    out: list[dict] = []
    for x, negated in zip(postfix, mask):
        out += pool[next(chosen)] if x < 0 else [logic.node(("and", "or")[(flip + level[x]) % 2], int(inner[x] + atoms[x]))]
        out += [logic.node("not", 1)] * bool(negated)
    return out


def record(tree: list[dict], rng: np.random.Generator, by_unit: bool = False) -> list[dict]:
    """Facts drawn near the bounds of a tree's atoms: a fifth are missing, a fifth of the rest denied; the last draw of an entity stays.

    by_unit: scale windows by their own unit rather than by months."""
    facts: dict[str, dict] = {}
    for a in (n for n in tree if n["kind"] == "atom"):
        if rng.random() < 0.2:
            continue
        f = {"name": a["entity"], "present": bool(rng.random() < 0.8), "value": None, "days_ago": None, "current": False}
        if a["num_op"]:
            wide = 3.0 if a["num_op"] == "between" else 2.5
            centre = (a["num_value"] + a["num_upper"]) / 2 if a["num_op"] == "between" else a["num_value"]
            f["value"] = round(float(rng.uniform(centre - wide, centre + wide)), 2)
        if a["tmp_op"] == "current":
            f["current"] = bool(rng.random() < 0.5)
            f["present"] = f["present"] or f["current"]
        elif a["tmp_op"] in logic.WINDOWED:
            days = (a["tmp_value"] or 1) * (logic.UNIT_DAYS[a["tmp_unit"]] if by_unit else WINDOW_DAYS)
            f["days_ago"] = round(float(rng.uniform(0.2 * days, 2.2 * days)), 1)
        facts.pop(a["entity"], None)
        facts[a["entity"]] = f
    return list(facts.values())


def as_map(facts):
    """The list of facts as the map that the evaluator reads."""
    pair = lambda f: F.struct(f["name"].alias("k"), F.struct(f["present"].alias("present"), f["value"].alias("value"), f["days_ago"].alias("days_ago"), f["current"].alias("current")).alias("v"))
    return F.map_from_entries(F.transform(facts, pair))


def items(spark: SparkSession, levels: dict[int, Callable[[list, np.random.Generator], list[dict]]], pool: list[list[dict]], per_level: int, attempts: int = 1, seed: int = 13) -> DataFrame:
    """level, number, attempt, tree, facts and gold; levels: level -> function of pool and generator that makes a tree."""
    grid = spark.range(per_level).select(F.explode(F.array(*(F.lit(v).cast("int") for v in levels))).alias("level"), F.col("id").alias("number"))
    grid = grid.select("level", "number", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    return _drawn(grid, levels, pool, seed)


def _drawn(grid: DataFrame, levels: dict, pool: list[list[dict]], seed: int) -> DataFrame:
    """The items of a grid (level, number, attempt)."""
    if len(pool) > MOST_ATOMS:
        raise ValueError(f"more than {MOST_ATOMS} atoms in the pool")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for level, number, attempt in zip(b["level"], b["number"], b["attempt"]):
                rng = np.random.default_rng([seed, int(level), int(number), int(attempt)])
                tree = levels[int(level)](pool, rng)
                out.append((level, number, attempt, tree, record(tree, rng)))
            yield pd.DataFrame(out, columns=["level", "number", "attempt", "tree", "facts"])

    return grid.mapInPandas(made, ITEM).withColumn("gold", logic.is_met(F.col("tree"), as_map(F.col("facts"))))


def half_met(made: DataFrame, per_level: int) -> DataFrame:
    """Of generated items, per_level // 2 that are met and the rest that aren't, of each level, the earliest first.

    Fails if the attempts don't fill a level's quotas."""
    made = written(made, "items")
    quota = F.when(F.col("gold"), per_level // 2).otherwise(per_level - per_level // 2)
    met, unmet = F.count_if("gold"), F.count_if(~F.col("gold"))
    short = made.groupBy("level").agg(met.alias("met"), unmet.alias("unmet")).where((F.col("met") < per_level // 2) | (F.col("unmet") < per_level - per_level // 2)).collect()
    if short:
        raise ValueError(f"too few attempts: {sorted((r['level'], r['met'], r['unmet']) for r in short)} (level, met, unmet)")
    place = F.row_number().over(Window.partitionBy("level", "gold").orderBy("attempt", "number"))
    return made.withColumn("__r", place).where(F.col("__r") <= quota).drop("__r")


#: Draws that a task makes.
DRAWS_A_TASK = 1000
#: Draws of a level that tell its rate: the first round makes no more.
PILOT = 1000
#: Draws of a level in the first round, as a multiple of what is asked for, and in all before a level counts as one that can't be filled.
FIRST, MOST_DRAWS = 2, 1000


def filled(spark: SparkSession, levels: dict[int, Callable[[list, np.random.Generator], list[dict]]], pool: list[list[dict]], per_level: int, seed: int = 13) -> DataFrame:
    """per_level items of each level, per_level // 2 of them met and the rest not: the first such draws, in order of their number.

    Rounds: each draws only for levels whose quotas aren't full, as many more as the rate so far says, so the work follows what
    is lacking. A draw depends on (seed, level, number) alone, so neither rounds nor partitions change the result. A level that
    isn't full after MOST_DRAWS draws an item is an error."""
    quota = {True: per_level // 2, False: per_level - per_level // 2}
    state = {v: {"drawn": 0, True: 0, False: 0} for v in levels}
    rounds: list[DataFrame] = []
    while wanted := {v: _next_draws(x, quota) for v, x in state.items() if any(x[g] < n for g, n in quota.items())}:
        grid = [(v, state[v]["drawn"], state[v]["drawn"] + n) for v, n in wanted.items()]
        hopeless = [v for v, _, end in grid if end > MOST_DRAWS * per_level]
        if hopeless:
            raise ValueError(f"levels that can't be filled: {sorted((v, state[v][True], state[v][False]) for v in hopeless)} (level, met, unmet)")
        numbers = spark.createDataFrame(grid, "level int, a long, b long").select("level", F.explode(F.sequence("a", F.col("b") - 1)).alias("number"))
        tasks = -(-sum(wanted.values()) // DRAWS_A_TASK)
        made = written(_drawn(numbers.repartition(tasks, "level", "number").withColumn("attempt", F.lit(0)), levels, pool, seed).drop("attempt"), "draws")
        rounds.append(made)
        for r in made.groupBy("level", "gold").agg(F.count(F.lit(1)).alias("n")).collect():
            state[r["level"]][r["gold"]] += r["n"]
        for v, n in wanted.items():
            state[v]["drawn"] += n
    all_ = reduce(DataFrame.unionByName, rounds)
    # Numbers alone are ranked, over as many tasks as they need; the items are cut at the last number of each quota where they are.
    ranks = running_sums(all_.select("level", "gold", "number", F.lit(1).cast("long").alias("one")), ["level", "gold"], "number", {"upto": "one"})
    ends = ranks.where(F.col("upto") <= F.when(F.col("gold"), quota[True]).otherwise(quota[False])).groupBy("level", "gold").agg(F.max("number").alias("end"))
    return all_.join(F.broadcast(written(ends, "quotas")), ["level", "gold"]).where(F.col("number") <= F.col("end")).drop("end").select(*all_.columns)


def _next_draws(x: dict, quota: dict[bool, int]) -> int:
    """How many draws a level that has x (drawn, met, unmet) gets next: by its rate so far, with a quarter to spare; of many draws with less."""
    if not x["drawn"]:
        return min(PILOT, FIRST * sum(quota.values()))
    need = max((quota[g] - x[g]) / (max(x[g], 1) / x["drawn"]) for g in (True, False))
    return int(max(16, min(1.25 * need, 1.06 * need + PILOT)))


def depth_ladder(spark: SparkSession, pool: list[list[dict]], depths: list[int], per_level: int, seed: int = 101) -> DataFrame:
    """Items of freely drawn trees, per_level of each depth, half of them met."""
    return filled(spark, {d: (lambda p, rng, d=d: nested(d, p, rng)) for d in depths}, pool, per_level, seed)


def size_sweep(spark: SparkSession, pool: list[list[dict]], sizes: list[int], per_level: int, depth: int = 3, seed: int = 13) -> DataFrame:
    """Items of one depth; level is the number of leaves, groups and negations grow with it."""
    levels = {n: (lambda p, rng, n=n: matched(depth, p, rng, n, max(depth, round(n * 3 / 7)), max(1, round(n * 2 / 7)))) for n in sizes}
    return filled(spark, levels, pool, per_level, seed)


def size_matched(spark: SparkSession, pool: list[list[dict]], depths: list[int], per_level: int, seed: int = 13) -> DataFrame:
    """Items of 14 leaves, 6 groups and 4 negations at each depth, half of them met."""
    return filled(spark, {d: (lambda p, rng, d=d: matched(d, p, rng)) for d in depths}, pool, per_level, seed)


def pool_of(atoms: DataFrame, tree: str = "tree", most: int = 2000) -> list[list[dict]]:
    """The distinct one-atom trees of a table as a pool, in order of their key: the `most` of least hash, if there are more (a bounded sample; MOST_ATOMS at most).

    Of atoms of one entity one stays, since a record has one fact of an entity."""
    one = atoms.where(F.size(tree) == 1).groupBy(F.col(tree)[0]["entity"].alias("e")).agg(F.min_by(tree, logic.key(F.col(tree))).alias("t"))
    rows = one.orderBy(F.xxhash64("e"), "e").limit(min(most, MOST_ATOMS)).collect()
    return [[n.asDict() for n in r["t"]] for r in sorted(rows, key=lambda r: r["e"])]


def paired(criteria: DataFrame, per_criterion: int = 2, seed: int = 17) -> DataFrame:
    """criteria (criterion_id, tree) each with per_criterion drawn records: item_id, criterion_id, tree, facts and gold."""
    grid = criteria.select("criterion_id", "tree", F.explode(F.sequence(F.lit(0), F.lit(per_criterion - 1))).alias("number"))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            facts = [record([dict(n) if isinstance(n, dict) else n.asDict() for n in t], np.random.default_rng([seed, number, *c.encode()])) for c, t, number in zip(b["criterion_id"], b["tree"], b["number"])]
            yield b.assign(facts=facts)

    rows = grid.mapInPandas(drawn, f"criterion_id string, tree {logic.TREE}, number int, facts {FACT_LIST}")
    ident = F.concat(F.lit("real:"), F.col("criterion_id"), F.lit(":"), F.lpad(F.col("number").cast("string"), 2, "0"))
    return rows.select(ident.alias("item_id"), "criterion_id", "tree", "facts", logic.is_met(F.col("tree"), as_map(F.col("facts"))).alias("gold"))
