"""Splitting of clusters: the statement against the operator, and the query against its statement where clusters outgrow 99 parts."""

import random
from collections import defaultdict

import duckdb
import pytest
from test_catalogue import DATA

from terravet.functions import geometry as G
from terravet.operators import locha
from terravet.plans import split_sql
from terravet.plans.catalogue import ORACLE_SQL, QUERIES

CHANGE = "cc_id long, objtype string, id long, geom struct<kind:string,parts:array<array<struct<x:double,y:double>>>>, b_geom struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"


def groups(rows):
    found = defaultdict(set)
    for i, *key in rows:
        found[tuple(key)].add(i)
    return set(map(frozenset, found.values()))


@pytest.mark.parametrize("wide", [3, 40])
def test_statement_splits_as_the_operator_does(spark, wide):
    """Small clusters and wide ones, some in tiles, one whose points of one spot have to be dealt."""
    rng = random.Random(wide)
    points = [(i * 4, i % 5 * 7, float(rng.randint(-wide, wide)), float(rng.randint(-wide, wide) // 2)) for i in range(900)]
    points += [(10_000 + i, 99, 5.0, float(i % 3 == 0)) for i in range(500)]
    got = locha.split_large(spark.createDataFrame(points, "id long, cluster long, x double, y double"), 0.4, most=20, at_once=170).collect()
    with duckdb.connect() as db:
        db.execute("CREATE TABLE places (id BIGINT, cluster BIGINT, x DOUBLE, y DOUBLE)")
        db.executemany("INSERT INTO places VALUES (?, ?, ?, ?)", points)
        want = db.execute("WITH RECURSIVE " + ",\n".join(split_sql.split("places", most=20, radius=8.0, at_once=170)) + " SELECT id, cluster, part FROM parted").fetchall()
    assert len(want) == len(points) and groups(want) == groups((r["id"], r["cluster"], r["part"]) for r in got)


def test_shapes_stand_in_order(spark):
    """After before before for every key, however many a task aggregates."""
    at = lambda x: ("point", [[(float(x), 0.0)]])
    rows = spark.createDataFrame([(i, "n", i, at(i), at(-i - 1)) for i in range(500)], CHANGE).coalesce(1)
    got = locha.clustering_input(rows, G.Projection()).collect()
    assert len(got) == 500 and all([p[0]["x"] for p in r["geom"]["parts"]] == [r["cc_id"], -r["cc_id"] - 1] for r in got)
    none = spark.createDataFrame([(1, "n", 1, None, None), (2, "n", 2, None, at(3))], CHANGE)
    assert {r["cc_id"]: r["geom"] and len(r["geom"]["parts"]) for r in locha.clustering_input(none, G.Projection()).collect()} == {1: None, 2: 1}


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
def test_same_place_where_clusters_are_split(spark, tmp_path):
    """150 nodes that began on one spot and moved to seven."""
    with duckdb.connect() as db:
        for name in ("part", "events", "customer", "orders", "lineitem"):
            keys = {"part": "CAST(1 + 6120 * j AS BIGINT) AS p_partkey", "events": "CAST(j AS BIGINT) AS event_id, CAST(1 + 6120 * j AS BIGINT) AS user_id, 'click' AS event_type"}.get(name)
            made = f"SELECT t.* REPLACE ({keys}) FROM (SELECT * FROM '{DATA}/{name}.parquet' LIMIT 1) t, range(150) r(j)" if keys else f"FROM '{DATA}/{name}.parquet'"
            db.execute(f"COPY ({made}) TO '{tmp_path}/{name}.parquet'")
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
        want = sorted(db.execute(f"SELECT objtype, id, first FROM ({ORACLE_SQL['locha_assign_same_place']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["locha_assign_same_place"](spark, str(tmp_path)).select("objtype", "id", "first").collect())
    assert got == want and len({first for _, _, first in got}) > 1
