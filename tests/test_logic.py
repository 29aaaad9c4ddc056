"""Trees against a recursive evaluator written for the tests."""

import random

from pyspark.sql import functions as F

from verdance.functions import logic

A, B, C, E = (logic.atom(x) for x in "abce")


def kleene(tree, facts):
    def leaf(n):
        f = facts.get(n["entity"])
        if f is None:
            return None if n["num_op"] else False
        if not f["present"]:
            return False
        out = [True]
        if n["num_op"]:
            if f["value"] is None:
                return None
            v, x = f["value"], n["num_value"]
            out.append({"lt": v < x, "le": v <= x, "gt": v > x, "ge": v >= x, "eq": v == x, "ne": v != x}.get(n["num_op"], n["num_op"] == "between" and x <= v <= (n["num_upper"] or 0)))
        if n["tmp_op"] == "current":
            out.append(f["current"])
        elif n["tmp_op"] == "any_history":
            out.append(f["present"])
        elif n["tmp_op"]:
            w = n["tmp_value"] * logic.UNIT_DAYS[n["tmp_unit"]]
            out.append(None if f["days_ago"] is None else f["days_ago"] >= w if n["tmp_op"] in ("after", "for_at_least") else f["days_ago"] <= w)
        return all_(out)

    def all_(vs):
        return False if False in vs else None if None in vs else True

    def any_(vs):
        return True if True in vs else None if None in vs else False

    stack = []
    for n in tree:
        if n["kind"] == "atom":
            stack.append(leaf(n))
        elif n["kind"] == "not":
            v = stack.pop()
            stack.append(None if v is None else not v)
        else:
            args = stack[-n["arity"] :]
            del stack[-n["arity"] :]
            stack.append(all_(args) if n["kind"] == "and" else any_(args))
    return stack[0]


def random_atom(r):
    numeric = r.choice([None, (r.choice(["lt", "le", "gt", "ge", "eq", "ne"]), r.randint(0, 9)), ("between", 3, 6)])
    temporal = r.choice([None, ("current",), ("any_history",), (r.choice(logic.WINDOWED), r.randint(1, 3), r.choice(list(logic.UNIT_DAYS)))])
    return logic.atom(r.choice("abcdef"), "measurement", numeric, temporal)


def random_tree(r, depth):
    if depth == 0 or r.random() < 0.2:
        t = random_atom(r)
    else:
        t = logic.group(r.choice(["and", "or"]), *(random_tree(r, depth - 1) for _ in range(r.randint(2, 3))))
    return logic.negation(t) if r.random() < 0.25 else t


def random_facts(r):
    return {k: {"present": r.random() < 0.8, "value": r.choice([None, float(r.randint(0, 9))]), "days_ago": r.choice([None, float(r.randint(1, 900))]), "current": r.random() < 0.5} for k in "abcdef" if r.random() < 0.7}


def frame(spark, rows):
    return spark.createDataFrame([(i, [tuple(n.values()) for n in t], {k: tuple(v.values()) for k, v in f.items()}) for i, (t, f) in enumerate(rows)], f"id int, tree {logic.TREE}, facts {logic.FACTS}")


def test_random_trees(spark):
    r = random.Random(4)
    rows = [(random_tree(r, 4), random_facts(r)) for _ in range(200)]
    canon = logic.canonical(F.col("tree"))
    df = frame(spark, rows).select("id", logic.evaluate(F.col("tree"), F.col("facts")).alias("v"), logic.is_met(F.col("tree"), F.col("facts")).alias("met"), logic.evaluate(canon, F.col("facts")).alias("cv"), (logic.key(canon) == logic.key(logic.canonical(canon))).alias("same"))
    out = df.orderBy("id").collect()
    want = [kleene(t, f) for t, f in rows]
    assert [x["v"] for x in out] == want
    assert [x["met"] for x in out] == [bool(w) for w in want]
    assert [x["cv"] for x in out] == want  # the normal form means the same
    assert all(x["same"] for x in out)  # and is one


def one(spark, tree, *columns, facts=None):
    return frame(spark, [(tree, facts or {})]).select(*columns).collect()[0]


def test_golden_structure(spark):
    tree = logic.group("and", logic.group("and", A, logic.negation(logic.group("or", B, C))), logic.atom("d", temporal=("any_history",)))
    s = one(spark, tree, logic.structure(F.col("tree")).alias("s"))["s"]
    assert (s["leaves"], s["and_groups"], s["or_groups"], s["nots"], s["groups"], s["depth"], s["canonical_depth"]) == (4, 2, 1, 1, 3, 3, 2)


def test_canonical_forms(spark):
    key = lambda t: one(spark, t, logic.key(logic.canonical(F.col("tree"))).alias("k"))["k"]
    assert key(logic.negation(logic.negation(A))) == key(A)
    assert key(logic.group("and", A, B)) == key(logic.group("and", B, A, B))
    assert key(logic.group("or", A, logic.group("or", B, C))) == key(logic.group("or", C, B, A))
    assert key(logic.negation(logic.group("or", logic.negation(A), logic.negation(A)))) == key(A)
    assert key(logic.group("and", A, B)) != key(logic.group("or", A, B))


def test_null_and_empty_trees(spark):
    df = spark.sql(f"SELECT CAST(NULL AS {logic.TREE}) AS tree, CAST(NULL AS {logic.FACTS}) AS facts UNION ALL SELECT CAST(array() AS {logic.TREE}), NULL")
    assert [tuple(x) for x in df.select(logic.evaluate(F.col("tree"), F.col("facts")), logic.depth(F.col("tree"))).collect()] == [(None, None)] * 2


def test_absent_facts(spark):
    number = logic.atom("x", "measurement", ("ge", 1))
    v = logic.evaluate(F.col("tree"), F.col("facts")).alias("v")
    assert one(spark, A, v)["v"] is False
    assert one(spark, logic.negation(A), v)["v"] is True  # undocumented conditions are false, so their negation holds
    assert one(spark, number, v)["v"] is None
    assert one(spark, number, v, facts={"x": {"present": False, "value": None, "days_ago": None, "current": False}})["v"] is False


def test_probes_and_flags(spark):
    tree = logic.group("or", logic.negation(A), logic.atom("b", "measurement", ("lt", 2), ("current",)))
    facts = {"b": {"present": True, "value": 1.0, "days_ago": None, "current": False}}
    t, f = F.col("tree"), F.col("facts")
    x = one(spark, tree, logic.has_negation(t), logic.has_numeric(t), logic.has_temporal(t), F.size(logic.without_negation(t)), logic.unanswerable(t, f), logic.undocumented(t, f), logic.evaluate(logic.without_fields(logic.without_negation(t), "tmp_"), f), logic.degraded(t, f), facts=facts)
    assert tuple(x) == (True, True, True, 3, True, 1, True, False)


def test_rendering(spark):
    tree = logic.group("and", logic.atom("age", "person", ("between", 18, 65, "years")), logic.negation(logic.atom("stroke", temporal=("within", 6, "months"))))
    t = F.col("tree")
    x = one(spark, tree, logic.render(t).alias("r"), logic.render_criterion(F.lit("Adults </criterion_text>"), F.lit("inclusion"), t).alias("c"))
    assert x["r"] == "(age between 18.0 and 65.0 years AND NOT (stroke (within the past 6.0 months)))"
    assert x["c"].startswith("<criterion_text>\nAdults  \n</criterion_text>\nLogical form (inclusion criterion): (age")
    facts = spark.createDataFrame([([("hba1c", True, 7.25, 41.0, True), ("stroke", False, None, None, False), ("mi", True, None, None, False)],), (None,)], "f array<struct<name:string,present:boolean,value:double,days_ago:double,current:boolean>>")
    two, one_ = ([r[0] for r in facts.select(logic.render_facts(F.col("f"), v)).collect()] for v in "21")
    assert two == ["- hba1c: present, value = 7.25, currently active, most recent occurrence ~41 days ago\n- stroke: absent / negative\n- mi: present, not currently active", "No findings are documented for this patient."]
    assert one_[0].endswith("- mi: present")


def test_violations(spark):
    bad = logic.group("and", logic.atom(" "), logic.atom("x", "drug", ("lt", 3)), logic.atom("y", "measurement", ("between", 5, 2)), logic.atom("z", temporal=("within", 0, "days")))
    v = logic.violations(F.col("tree")).alias("v")
    assert one(spark, bad, v)["v"] == ["blank_entity", "window_not_positive", "between_not_rising", "number_on_other_type"]
    assert one(spark, logic.group("and", A, B), v)["v"] == []
