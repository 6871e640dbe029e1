"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from strandjoin.plans import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def test_every_query_has_its_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    made = duck.execute(SQL[name])
    assert sorted(c[0] for c in made.description) == columns
    order = [[c[0] for c in made.description].index(c) for c in columns]
    want = sorted((plain(tuple(r[i] for i in order)) for r in made.fetchall()), key=str)
    got = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=str)
    assert got == want
