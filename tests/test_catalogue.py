"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from driver_tables import SF

from waymark.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_queries_without_sql(spark):
    rest = sorted(set(QUERIES) - set(ORACLES))
    assert rest == ["affine_sums", "mst_bridge", "network_nodes", "spelling_ratio", "thinned_roads"]
    for name in rest:
        assert QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["pushdown_bbox"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in plan


@pytest.mark.parametrize("name", ["radius_pairs", "nearest_ties", "coincident_box"])
def test_distance_joins_are_equi_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
