"""The queries of this subpackage that SQL can express, against their SQL in DuckDB, on the smallest tables, if they are here."""

import os

import pytest

from verdance.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows, columns: sorted(repr([r[columns.index(c)] if not isinstance(r[columns.index(c)], float) else round(r[columns.index(c)], 9) for c in sorted(columns)]) for r in rows)
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), names)
