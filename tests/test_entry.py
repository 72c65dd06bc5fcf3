"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from flowlens import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: "null" if x is None or x != x else f"{x:.8g}" if isinstance(x, float) else str(int(x) if isinstance(x, bool) else x)
    return sorted("|".join(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
