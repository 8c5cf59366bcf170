import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

from scoreline.plans.catalog import QUERIES  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["jugador", "pts", "avg", "avg_rounded"]
    assert df.count() > 0


def test_every_own_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def _duck(sf):
    con = duckdb.connect()
    for t in ("lineitem", "customer", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_flagship_against_oracle(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in E.queries()["pool_leaderboard"](spark, sf).collect())
    res = _duck(sf).execute(E.oracle_sql()["pool_leaderboard"])
    cols = [d[0] for d in res.description]
    assert cols == ["jugador", "pts", "avg", "avg_rounded"]
    assert got == sorted(res.fetchall())
