"""Kept geometry after each of several updates against geometry from nothing; how much is computed again."""

import random

from pyspark.sql import functions as F

from terravet import schemas
from terravet.operators import shapes
from terravet.plans.geometries import Geometries
from terravet.plans.keyed import KeyedTable
from terravet.plans.tables import Steps
from tests import domain as D

KINDS = {"n": "nodes", "w": "ways", "r": "relations"}


def tables(spark, tmp_path):
    kind = {"nodes": schemas.NODE, "ways": schemas.WAY, "relations": schemas.RELATION}
    base = {name: KeyedTable(spark, f"file://{tmp_path}/{name}", s, 3) for name, s in kind.items()}
    return base, Geometries.under(base, f"file://{tmp_path}")


def plain(df):
    return {(r["objtype"], r["id"]): None if r["geom"] is None else (r["geom"]["kind"], [[(p["x"], p["y"]) for p in part] for part in r["geom"]["parts"]]) for r in df.collect()}


def kept(g):
    tag = lambda df, t: df.select(F.lit(t).alias("objtype"), "id", "geom")
    return plain(tag(g.lines.read(), "w").unionByName(tag(g.areas.read(), "r")))


def from_nothing(base):
    return {k: v for k, v in plain(shapes.base_shapes(*[base[x].read() for x in KINDS.values()])).items() if k[0] != "n"}


def test_every_update_gives_what_a_build_gives(spark, tmp_path):
    rng = random.Random(8)
    base, g = tables(spark, tmp_path)
    base["nodes"].replace(D.nodes(spark, *[(i, None, rng.randint(0, 9), rng.randint(0, 9)) for i in range(1, 40)]))
    base["ways"].replace(D.ways(spark, *[(i, None, [rng.randint(1, 42) for _ in range(4)]) for i in range(1, 20)]))
    base["relations"].replace(D.relations(spark, *[(i, None, [(rng.randint(1, 22), "", "w"), (rng.randint(1, 42), "", "n")]) for i in range(1, 9)]))
    assert not g.fresh()
    g.current()
    assert g.fresh() and kept(g) == from_nothing(base)
    for k in range(4):
        new = [("n", i, 2, rng.random() < 0.3, None, rng.randint(0, 9), rng.randint(0, 9), None) for i in rng.sample(range(1, 45), 2)]
        new += [("w", rng.randint(1, 24), 2, rng.random() < 0.3, None, None, None, [rng.randint(1, 42) for _ in range(3)])]
        new += [("r", rng.randint(1, 10), 2, rng.random() < 0.3, None, None, None, None, [(rng.randint(1, 24), "", "w")])] if k % 2 else []
        changed, steps = D.changes(spark, *new), Steps(spark, "t")
        moved = steps.keep(g.moved(changed))
        for t, name in KINDS.items():
            base[name].change(changed.filter(F.col("objtype") == t).withColumn("gone", F.col("deleted")))
        assert not g.fresh()
        done = g.refresh(moved, steps)
        ids = lambda t: moved.filter(F.col("objtype") == t).select("id")
        hit = shapes.dirty(base["ways"].read(), base["relations"].read(), ids("n"), ids("w"), ids("r"))
        assert sum(done) == hit.count() and g.fresh() and kept(g) == from_nothing(base)


def test_only_what_an_update_touches_is_computed(spark, tmp_path):
    base, g = tables(spark, tmp_path)
    base["nodes"].replace(D.nodes(spark, *[(i, None, i % 50, i // 50) for i in range(1, 1001)]))
    base["ways"].replace(D.ways(spark, *[(i, None, [4 * i + 1, 4 * i + 2, 4 * i + 3]) for i in range(200)]))
    base["relations"].replace(D.relations(spark, *[(i, None, [(2 * i, "", "w"), (2 * i + 1, "", "w")]) for i in range(100)]))
    g.current()
    steps = Steps(spark, "t")
    tags = D.changes(spark, ("n", 5, 2, False, {"name": "x"}, 5 % 50, 5 // 50, None))
    assert g.moved(tags).count() == 0
    one = D.changes(spark, ("n", 5, 2, False, None, 77, 77, None))
    moved = steps.keep(g.moved(one))
    base["nodes"].change(one.withColumn("gone", F.col("deleted")))
    assert g.refresh(moved, steps) == (1, 1)
    assert [d["rows"] for d in g.lines.manifest().deltas] == [1] and kept(g)[("w", 1)][1][0][0] == (77.0, 77.0)
    # A base put in place otherwise is noticed.
    base["nodes"].replace(base["nodes"].read().withColumn("lon", F.lit(1.0)))
    assert not g.fresh() and kept(g.current()) == from_nothing(base)
