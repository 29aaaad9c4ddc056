"""Every query of the library against its SQL in DuckDB, on the smallest tables, if they are here."""

import glob
import math
import os

import pytest

from verdance.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else int(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert df.columns
        return
    cur = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = cur.fetchall()
    assert plain(rows, df.columns) == plain(want, names)


def test_simulations_have_the_operators_replicates(spark, monkeypatch):
    assert queries.QUERIES["permutation_trend"](spark, SF).collect()[0]["n_permutations"] == 20_000
    assert 2000 < queries.QUERIES["kappa_interval"](spark, SF).collect()[0]["n_draws"] <= 5000
    given = []
    monkeypatch.setattr(queries.trend, "item_trend", lambda table, **more: given.append(more))
    queries.QUERIES["item_trend"](spark, SF)
    assert given == [{}]
