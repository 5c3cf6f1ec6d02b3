"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairn.plans.queries import ORACLE, QUERIES
from cairn.plans.registry import TABLES, view

SF = "/root/testdata/sf0.001"
#: Long chains of rounds; their operators have tests of their own.
SLOW = {"GRF-7", "GRF-8", "GRF-9", "GRF-10", "GRF-11", "GRF-12", "GRF-13", "GRF-14", "GRF-15", "GRF-4", "JOIN-11"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, float | np.floating):
        return f"{float(x):.9g}"
    if isinstance(x, list | np.ndarray):
        return str([plain(y) for y in x])
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert rows(found) == rows(con.execute(ORACLE[name]).fetchdf())


def test_trips_of_all_kinds(spark, con):
    """Routes at once, only when asked again, and none for each of the reasons."""
    from cairn.plans.routing import trips
    from cairn.operators.routes import outcomes

    s, t, found = trips(spark, SF)
    asked = view(spark, SF, "v_mesh_trips").selectExpr("request_id as request")
    status = outcomes(asked, s, t, found).toPandas()
    assert rows(status) == rows(con.execute(ORACLE["GRF-14"]).fetchdf())
    assert set(status["status"]) == {"ok", "no-start", "no-end", "no-route"}
    retried = found.select("request", "retried").toPandas()
    assert rows(retried) == rows(con.execute(ORACLE["GRF-8"]).fetchdf()) and set(retried["retried"]) == {True, False}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_each_supplier_is_a_route_request(spark):
    base = "/root/testdata/sf0.01"
    assert view(spark, base, "v_route_requests").count() == spark.read.parquet(f"{base}/supplier.parquet").count()


@pytest.mark.parametrize("name", ["FLT-13", "SET-1", "AGG-1", "SET-2", "WIN-9"])
def test_trails_meet_parts_by_key(spark, name):
    """No plan holds each order against each part."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("Join" in line and ", ferrata)" in line and "p_partkey" not in line for line in plan.splitlines())
