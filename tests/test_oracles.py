"""Every registered query against its independent DuckDB oracle on sf0.001 (order-insensitive)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from salescope.plans import registry
from salescope.plans.oracles import oracle_sql
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_is_registered_and_has_an_oracle():
    qs = registry.queries()
    assert set(qs) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert len(qs) >= 120
    assert set(qs) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    sdf = registry.queries()[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(srows, sdf.columns)[0] == digest(orows, ocols)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 97  # 92 High + 5 Medium at as_of 2001-08-01
    assert df.columns[:3] == ["Item_Code", "Item_Desc", "Brand"]
