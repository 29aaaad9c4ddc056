"""Boolean trees as postfix arrays, and what can be asked of them, as Column functions.

A tree is an array of NODE structs in postfix order: operands come before their group. Every
function here is a stack machine over that array (`aggregate`), so a whole tree is evaluated in one
narrow projection: no shuffle, no Python worker. Facts are a map from an entity's text to FACT.

Truth is three-valued: NULL is unknown. `exists` and `forall` are three-valued in Spark, so they are
the connectives; `bool_and` and `bool_or` skip NULL and are not.

Defined cases: a null or empty tree is NULL in every function; a null fact map has no facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_FIELDS = [
    ("kind", "string"), ("arity", "int"), ("entity", "string"), ("type", "string"),
    ("num_op", "string"), ("num_value", "double"), ("num_upper", "double"), ("num_unit", "string"),
    ("num_lo_incl", "boolean"), ("num_hi_incl", "boolean"),
    ("tmp_op", "string"), ("tmp_value", "double"), ("tmp_unit", "string"), ("tmp_anchor", "string"),
]
NODE = "struct<" + ",".join(f"{n}:{t}" for n, t in NODE_FIELDS) + ">"
TREE = f"array<{NODE}>"
FACT = "struct<present:boolean,value:double,days_ago:double,current:boolean>"
FACTS = f"map<string,{FACT}>"

#: Days of a unit of time.
UNIT_DAYS = {"days": 1.0, "weeks": 7.0, "months": 30.4375, "years": 365.25}
#: Operators of time with a window, and without.
WINDOWED = ["within", "before", "after", "for_at_least", "for_at_most"]
BARE = ["current", "any_history"]
#: Entity types that a number may bound.
MEASURABLE = ["measurement", "observation", "person"]
#: How a comparison is written.
SYMBOLS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "!="}


# Trees in Python: lists of dicts, for literals, tests and generators.


def node(kind: str, arity: int = 0, **fields) -> dict:
    return {n: None for n, _ in NODE_FIELDS} | {"kind": kind, "arity": arity} | fields


def atom(entity: str, type_: str = "condition", numeric: tuple | None = None, temporal: tuple | None = None) -> list[dict]:
    """numeric: (op, value[, upper[, unit]]); temporal: (op[, value, unit])."""
    fields: dict = {"entity": entity, "type": type_}
    if numeric:
        op, value, *rest = numeric
        fields |= {"num_op": op, "num_value": float(value), "num_upper": float(rest[0]) if rest and rest[0] is not None else None, "num_unit": rest[1] if len(rest) > 1 else None, "num_lo_incl": True, "num_hi_incl": True}
    if temporal:
        op, *rest = temporal
        fields |= {"tmp_op": op, "tmp_value": float(rest[0]) if rest else None, "tmp_unit": rest[1] if len(rest) > 1 else None, "tmp_anchor": "enrollment"}
    return [node("atom", **fields)]


def negation(tree: list[dict]) -> list[dict]:
    return [*tree, node("not", 1)]


def group(op: str, *trees: list[dict]) -> list[dict]:
    return [n for t in trees for n in t] + [node(op, len(trees))]


def literal(tree: list[dict]) -> Column:
    """A tree in Python as a Column."""
    return F.array(*(F.struct(*(F.lit(n[k]).cast(t).alias(k) for k, t in NODE_FIELDS)) for n in tree)).cast(TREE)


# The stack machine.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(tree: Column, kind: str, leaf: Callable[[Column], Column], inner: Callable[[Column, Column], Column]) -> Column:
    """The value (of SQL type `kind`) at the root: leaf(node) of atoms, inner(node, operands' values) of the rest."""

    def step(stack: Column, n: Column) -> Column:
        keep = F.size(stack) - n["arity"]
        top = F.slice(stack, keep + 1, n["arity"])
        value = F.when(n["kind"] == "atom", leaf(n)).otherwise(inner(n, top))
        return F.concat(F.slice(stack, F.lit(1), keep), F.array(value.cast(kind)))

    return F.try_element_at(F.aggregate(tree, F.expr(f"CAST(array() AS array<{kind}>)"), step), F.lit(-1))


# Evaluation.


def holds_numeric(n: Column, value: Column) -> Column:
    low = F.when(F.coalesce(n["num_lo_incl"], F.lit(True)), value >= n["num_value"]).otherwise(value > n["num_value"])
    high = F.when(F.coalesce(n["num_hi_incl"], F.lit(True)), value <= n["num_upper"]).otherwise(value < n["num_upper"])
    op, x = n["num_op"], n["num_value"]
    return F.when(op == "lt", value < x).when(op == "le", value <= x).when(op == "gt", value > x).when(op == "ge", value >= x).when(op == "eq", value == x).when(op == "ne", value != x).when(op == "between", low & high)


def holds_temporal(n: Column, fact: Column) -> Column:
    """The anchor of a window is not looked at: recency is always that at the anchor."""
    op = n["tmp_op"]
    days = F.lit(None).cast("double")
    for unit, d in UNIT_DAYS.items():
        days = F.when(n["tmp_unit"] == unit, F.lit(d)).otherwise(days)
    window = F.coalesce(n["tmp_value"], F.lit(0.0)) * days
    ago = fact["days_ago"]
    return F.when(op == "current", F.coalesce(fact["current"], F.lit(False))).when(op == "any_history", F.coalesce(fact["present"], F.lit(True))).when(op.isin("within", "before", "for_at_most"), ago <= window).when(op.isin("after", "for_at_least"), ago >= window)


def atom_holds(n: Column, facts: Column) -> Column:
    """An absent number is unknown; any other absent or denied fact is false."""

    def of(fact: Column) -> Column:
        numeric = F.when(n["num_op"].isNull(), F.lit(True)).otherwise(holds_numeric(n, fact["value"]))
        temporal = F.when(n["tmp_op"].isNull(), F.lit(True)).otherwise(holds_temporal(n, fact))
        return (
            F.when(fact.isNull() & n["num_op"].isNotNull(), F.lit(None))
            .when(fact.isNull() | ~F.coalesce(fact["present"], F.lit(True)), F.lit(False))
            .when(n["num_op"].isNotNull() & fact["value"].isNull(), F.lit(None))
            .otherwise(numeric & temporal)
            .cast("boolean")
        )

    return let(F.try_element_at(facts, n["entity"]), of)


def _connect(n: Column, top: Column) -> Column:
    return F.when(n["kind"] == "not", ~F.get(top, F.lit(0))).when(n["kind"] == "and", F.forall(top, lambda v: v)).otherwise(F.exists(top, lambda v: v))


def evaluate(tree: Column, facts: Column) -> Column:
    """True, false or NULL (unknown)."""
    known = F.coalesce(facts, F.expr(f"CAST(map() AS {FACTS})"))
    return fold(tree, "boolean", lambda n: atom_holds(n, known), _connect)


def is_met(tree: Column, facts: Column, unknown: bool = False) -> Column:
    """The value of the tree with unknown collapsed; polarity is not applied."""
    return F.coalesce(evaluate(tree, facts), F.lit(unknown))


def degraded(tree: Column, facts: Column) -> Column:
    """A diagnostic reader that overlooks every negation and reads an alternative's first branch only."""
    known = F.coalesce(facts, F.expr(f"CAST(map() AS {FACTS})"))
    inner = lambda n, top: F.when(n["kind"] == "and", F.forall(top, lambda v: v)).otherwise(F.get(top, F.lit(0)))
    return fold(tree, "boolean", lambda n: atom_holds(n, known), inner)


# Structure.


def depth(tree: Column) -> Column:
    """Atoms have 0; a negation adds nothing; a group has one more than its deepest operand."""
    return fold(tree, "int", lambda n: F.lit(0), lambda n, top: F.when(n["kind"] == "not", F.get(top, F.lit(0))).otherwise(F.array_max(top) + 1))


def leaves(tree: Column) -> Column:
    """The atoms from left to right, repeats included."""
    return F.filter(tree, lambda n: n["kind"] == "atom")


def _count(tree: Column, *kinds: str) -> Column:
    return F.size(F.filter(tree, lambda n: n["kind"].isin(*kinds)))


def _token(n: Column) -> Column:
    return F.concat_ws("\u001f", *(F.coalesce(n[k].cast("string"), F.lit("\u0000")) for k, _ in NODE_FIELDS))


def key(tree: Column) -> Column:
    """A string that tells trees apart; the same for the same tree only."""
    return F.array_join(F.transform(tree, _token), "\u001e")


def operands(tree: Column) -> Column:
    """The operands of the root as array<struct<nodes>>; empty for an atom."""
    part = f"struct<nodes:{TREE}>"

    def step(stack: Column, n: Column) -> Column:
        keep = F.size(stack) - n["arity"]
        own = F.concat(F.flatten(F.transform(F.slice(stack, keep + 1, n["arity"]), lambda p: p["nodes"])), F.array(n))
        return F.concat(F.slice(stack, F.lit(1), keep), F.array(F.struct(own.alias("nodes")).cast(part)))

    return F.aggregate(F.slice(tree, F.lit(1), F.size(tree) - 1), F.expr(f"CAST(array() AS array<{part}>)"), step)


def canonical(tree: Column) -> Column:
    """The normal form: same-operator groups flattened, operands distinct and in order of their key,
    double negations gone, groups of one operand unwrapped. Applying it again changes nothing."""
    part = f"struct<nodes:{TREE}>"
    last = lambda p: F.element_at(p["nodes"], -1)

    def negated(p: Column) -> Column:
        twice = F.slice(p["nodes"], F.lit(1), F.size(p["nodes"]) - 1)
        once = F.concat(p["nodes"], literal([node("not", 1)]))
        return F.struct(F.when(last(p)["kind"] == "not", twice).otherwise(once).alias("nodes"))

    def grouped(n: Column, top: Column) -> Column:
        flat = F.flatten(F.transform(top, lambda p: F.when(last(p)["kind"] == n["kind"], operands(p["nodes"])).otherwise(F.array(p))))
        ordered = F.transform(F.array_sort(F.transform(F.array_distinct(flat), lambda p: F.struct(key(p["nodes"]).alias("k"), p["nodes"].alias("nodes")))), lambda s: F.struct(s["nodes"].alias("nodes")))
        whole = lambda ops: F.concat(F.flatten(F.transform(ops, lambda p: p["nodes"])), F.array(n.withField("arity", F.size(ops))))
        return let(ordered, lambda ops: F.when(F.size(ops) == 1, F.get(ops, F.lit(0))).otherwise(F.struct(whole(ops).alias("nodes")).cast(part)))

    def inner(n: Column, top: Column) -> Column:
        return F.when(n["kind"] == "not", negated(F.get(top, F.lit(0))).cast(part)).otherwise(grouped(n, top).cast(part))

    return fold(tree, part, lambda n: F.struct(F.array(n).alias("nodes")).cast(part), inner)["nodes"]


def structure(tree: Column) -> Column:
    """struct(leaves, and_groups, or_groups, nots, groups, depth, canonical_depth)."""
    return F.struct(
        _count(tree, "atom").alias("leaves"), _count(tree, "and").alias("and_groups"), _count(tree, "or").alias("or_groups"), _count(tree, "not").alias("nots"),
        _count(tree, "and", "or").alias("groups"), depth(tree).alias("depth"), depth(canonical(tree)).alias("canonical_depth"),
    )


def undocumented(tree: Column, facts: Column) -> Column:
    """How many leaves have no fact."""
    return F.size(F.filter(leaves(tree), lambda n: F.try_element_at(facts, n["entity"]).isNull()))


def currency_ambiguous(tree: Column, facts: Column) -> Column:
    """How many leaves without a time have a fact that is present and not current."""

    def unclear(n: Column) -> Column:
        f = F.try_element_at(facts, n["entity"])
        return n["tmp_op"].isNull() & f.isNotNull() & F.coalesce(f["present"], F.lit(True)) & ~F.coalesce(f["current"], F.lit(False))

    return F.size(F.filter(leaves(tree), lambda n: F.coalesce(unclear(n), F.lit(False))))


def unanswerable(tree: Column, facts: Column) -> Column:
    """Whether some leaf asks for a current state of which the record says only that it is present."""

    def unstated(n: Column) -> Column:
        f = F.try_element_at(facts, n["entity"])
        return (n["tmp_op"] == "current") & f.isNotNull() & F.coalesce(f["present"], F.lit(True)) & ~F.coalesce(f["current"], F.lit(False))

    return F.exists(leaves(tree), lambda n: F.coalesce(unstated(n), F.lit(False)))


def has_temporal(tree: Column) -> Column:
    return F.exists(tree, lambda n: n["tmp_op"].isNotNull())


def has_numeric(tree: Column) -> Column:
    return F.exists(tree, lambda n: n["num_op"].isNotNull())


def has_negation(tree: Column) -> Column:
    return F.exists(tree, lambda n: n["kind"] == "not")


def without_negation(tree: Column) -> Column:
    return F.filter(tree, lambda n: n["kind"] != "not")


def without_fields(tree: Column, prefix: str) -> Column:
    """The tree with all fields of a prefix (`num_` or `tmp_`) null."""

    def cleared(n: Column) -> Column:
        return F.struct(*((F.lit(None).cast(t) if k.startswith(prefix) else n[k]).alias(k) for k, t in NODE_FIELDS))

    return F.transform(tree, cleared)


# What makes a node invalid.


def violations(tree: Column) -> Column:
    """array<string> of the constraints that some node breaks, in a fixed order; empty if the tree is sound."""
    windowed, bare = F.array(*map(F.lit, WINDOWED)), F.array(*map(F.lit, BARE))
    rules: list[tuple[str, Callable[[Column], Column]]] = [
        ("blank_entity", lambda n: (n["kind"] == "atom") & (F.trim(F.coalesce(n["entity"], F.lit(""))) == "")),
        ("window_without_magnitude", lambda n: F.array_contains(windowed, n["tmp_op"]) & (n["tmp_value"].isNull() | n["tmp_unit"].isNull())),
        ("window_not_positive", lambda n: F.array_contains(windowed, n["tmp_op"]) & (n["tmp_value"] <= 0)),
        ("bare_with_magnitude", lambda n: F.array_contains(bare, n["tmp_op"]) & (n["tmp_value"].isNotNull() | n["tmp_unit"].isNotNull())),
        ("between_without_upper", lambda n: (n["num_op"] == "between") & n["num_upper"].isNull()),
        ("between_not_rising", lambda n: (n["num_op"] == "between") & (n["num_upper"] <= n["num_value"])),
        ("upper_without_between", lambda n: (n["num_op"] != "between") & n["num_upper"].isNotNull()),
        ("number_on_other_type", lambda n: n["num_op"].isNotNull() & ~n["type"].isin(*MEASURABLE)),
        ("group_of_one", lambda n: n["kind"].isin("and", "or") & (n["arity"] < 2)),
    ]

    def broken(rule: Callable[[Column], Column]) -> Column:
        return F.exists(tree, lambda n: F.coalesce(rule(n), F.lit(False)))

    return F.array_compact(F.array(*(F.when(broken(rule), F.lit(name)) for name, rule in rules)))


# Rendering.


def number(x: Column) -> Column:
    """A double as Python writes it, of 1e-3 to 1e7 in size."""
    return x.cast("string")


def short_number(x: Column) -> Column:
    """A double with at most six significant digits and no trailing zeros."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))))
    return F.regexp_replace((F.round(x * scale, 0) / scale).cast("string"), r"\.0$", "")


def render_atom(n: Column) -> Column:
    unit = F.when(F.coalesce(n["num_unit"], F.lit("")) != "", F.concat(F.lit(" "), n["num_unit"])).otherwise("")
    symbol = F.lit("")
    for op, s in SYMBOLS.items():
        symbol = F.when(n["num_op"] == op, F.lit(s)).otherwise(symbol)
    numeric = F.when(n["num_op"] == "between", F.concat(F.lit("between "), number(n["num_value"]), F.lit(" and "), number(n["num_upper"]), unit)).otherwise(F.concat(symbol, F.lit(" "), number(n["num_value"]), unit))
    size = F.concat(number(n["tmp_value"]), F.lit(" "), F.coalesce(n["tmp_unit"], F.lit("")))
    op = n["tmp_op"]
    # How operators of time are worded.
    temporal = (
        F.when(op == "current", "current / ongoing").when(op == "any_history", "at any time in history")
        .when(op == "within", F.concat(F.lit("within the past "), size)).when(op == "before", F.concat(F.lit("before enrollment by "), size))
        .when(op == "after", F.concat(F.lit("after enrollment by "), size)).when(op == "for_at_least", F.concat(F.lit("for at least "), size))
        .when(op == "for_at_most", F.concat(F.lit("for at most "), size)).otherwise(op)
    )
    return F.concat(n["entity"], F.when(n["num_op"].isNotNull(), F.concat(F.lit(" "), numeric)).otherwise(""), F.when(op.isNotNull(), F.concat(F.lit(" ("), temporal, F.lit(")"))).otherwise(""))


def render(tree: Column) -> Column:
    """The tree as parenthesised text."""

    def inner(n: Column, top: Column) -> Column:
        joined = F.when(n["kind"] == "and", F.array_join(top, " AND ")).otherwise(F.array_join(top, " OR "))
        return F.when(n["kind"] == "not", F.concat(F.lit("NOT ("), F.get(top, F.lit(0)), F.lit(")"))).otherwise(F.concat(F.lit("("), joined, F.lit(")")))

    return fold(tree, "string", render_atom, inner)


def render_criterion(text: Column, polarity: Column, tree: Column, version: str = "2") -> Column:
    """Source text, if there is any, and the rendered tree; version 2 fences the text and takes the fence out of it."""
    logic, body = render(tree), F.trim(F.coalesce(text, F.lit("")))
    tail = F.concat(F.lit("\nLogical form ("), polarity, F.lit(" criterion): "), logic)
    if version == "1":
        shown = F.concat(F.lit('"'), body, F.lit('"'), tail)
    else:
        safe = F.replace(F.replace(body, F.lit("<criterion_text>"), F.lit(" ")), F.lit("</criterion_text>"), F.lit(" "))
        shown = F.concat(F.lit("<criterion_text>\n"), safe, F.lit("\n</criterion_text>"), tail)
    return F.when((body != "") & ~F.startswith(body, F.lit("(")), shown).otherwise(F.concat(F.lit("("), polarity, F.lit(" criterion) "), logic))


def render_facts(facts: Column, version: str = "2") -> Column:
    """facts: an array of struct(name, present, value, days_ago, current) in the order to show; version 2 says if a finding is not current."""

    def line(f: Column) -> Column:
        current = F.when(F.coalesce(f["current"], F.lit(False)), F.lit("currently active"))
        if version != "1":
            current = current.otherwise("not currently active")
        bits = F.array_compact(F.array(F.lit("present"), F.when(f["value"].isNotNull(), F.concat(F.lit("value = "), number(f["value"]))), current, F.when(f["days_ago"].isNotNull(), F.concat(F.lit("most recent occurrence ~"), short_number(f["days_ago"]), F.lit(" days ago")))))
        return F.concat(F.lit("- "), f["name"], F.lit(": "), F.when(F.coalesce(f["present"], F.lit(True)), F.array_join(bits, ", ")).otherwise("absent / negative"))

    empty = facts.isNull() | (F.size(facts) == 0)
    return F.when(empty, "No findings are documented for this patient.").otherwise(F.array_join(F.transform(facts, line), "\n"))


def to_sql(tree: list[dict], fact: Callable[[str], dict[str, str]]) -> str:
    """A tree in Python as a SQL condition, for oracles: fact(entity) names the SQL columns present, value, days_ago and current; present is NULL where there is no fact."""
    stack: list[str] = []
    for n in tree:
        if n["kind"] == "atom":
            f = fact(n["entity"])
            parts = []
            if n["num_op"] == "between":
                parts.append(f"({f['value']} >= {n['num_value']} AND {f['value']} <= {n['num_upper']})")
            elif n["num_op"]:
                parts.append(f"({f['value']} {SYMBOLS[n['num_op']]} {n['num_value']})".replace("!=", "<>"))
            if n["tmp_op"] == "current":
                parts.append(f["current"])
            elif n["tmp_op"] in WINDOWED:
                parts.append(f"({f['days_ago']} {'>=' if n['tmp_op'] in ('after', 'for_at_least') else '<='} {n['tmp_value'] * UNIT_DAYS[n['tmp_unit']]})")
            absent = "NULL" if n["num_op"] else "false"
            value = f" WHEN {f['value']} IS NULL THEN NULL" if n["num_op"] else ""
            stack.append(f"(CASE WHEN {f['present']} IS NULL THEN {absent} WHEN NOT {f['present']} THEN false{value} ELSE {' AND '.join(parts) or 'true'} END)")
        elif n["kind"] == "not":
            stack.append(f"(NOT {stack.pop()})")
        else:
            args = stack[len(stack) - n["arity"] :]
            del stack[len(stack) - n["arity"] :]
            stack.append("(" + f" {n['kind'].upper()} ".join(args) + ")")
    return stack[-1]
