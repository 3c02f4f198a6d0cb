"""Registered queries against their DuckDB statements, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from terravet.plans.catalogue import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001"))
#: The graph stages run many small jobs; tests/test_target.py has their scenarios, and one stands here for all.
SLOW = {"edges", "components", "component_histogram", "component_invariants", "propagate_relations", "integrity_same"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float) and x == int(x):
        return int(x)
    return x if isinstance(x, (int, float, bool)) else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_statement(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in found.description], found.fetchall())


def test_every_query_has_a_statement_or_a_reason():
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert name in {"kmeans_split", "locha_assign", "released_with_geometry", "line_merge", "review_features"}


def test_spread_of_work_stays_on_keys(spark):
    """No cross or nested-loop join in the plans of joins by place or reference."""
    for name in ("duplicates_diff", "network_diff", "way_bbox", "dirty_set", "fk_missing_nodes", "overlay_vertices"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["tag_filter"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "p_name" not in plan
