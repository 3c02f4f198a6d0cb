"""Tables that grow with the base aren't sent whole to every executor, which gathers them on the driver."""

from pyspark.sql import functions as F

from terravet.operators import ingest
from terravet.plans import tables as T
from terravet.plans.keyed import KeyedTable
from terravet.plans.tables import Steps, unsent
from tests import domain as D
from tests.test_geometries import KINDS, from_nothing, kept, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_and_its_geometry(spark, tmp_path, monkeypatch):
    base, g = tables(spark, tmp_path)
    base["nodes"].replace(D.nodes(spark, *[(i, None, i % 50, i // 50) for i in range(1, 201)]))
    base["ways"].replace(D.ways(spark, *[(i, None, [4 * i + 1, 4 * i + 2, 4 * i + 3]) for i in range(50)]))
    base["relations"].replace(D.relations(spark, *[(i, None, [(2 * i, "", "w"), (2 * i + 1, "", "w"), (i + 1, "", "n")]) for i in range(25)]))
    plans = []
    for name in ("replace", "change"):
        monkeypatch.setattr(KeyedTable, name, lambda self, rows, *a, f=getattr(KeyedTable, name): plans.append(plan(rows)) or f(self, rows, *a))
    g.build()
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
    changed, steps = D.changes(spark, ("n", 5, 2, False, None, 77, 77, None), ("w", 3, 2, True, None, None, None, [1]), ("r", 9, 2, False, None, None, None, None, [(5, "", "w")])), Steps(spark, "t")
    moved = steps.keep(g.moved(changed))
    for t, name in KINDS.items():
        base[name].change(changed.filter(F.col("objtype") == t).withColumn("gone", F.col("deleted")))
    plans.clear()
    monkeypatch.setattr(T, "SENT", 0)
    done = g.refresh(moved, steps)
    assert all(done) and len(plans) == 2 and not any("Broadcast" in p for p in plans)
    assert kept(g) == from_nothing(base)
    assert "Broadcast" not in plan(base["nodes"].read())


def test_keys_of_the_base(spark):
    steps = Steps(spark, "t")
    queue = steps.keep(D.changes(spark, ("n", 1, 2, True, None, 1, 1, None), ("n", 2, 2, True, None, 1, 1, None)))
    left = ingest.prune_unknown_deletes(queue, steps.keep(D.base(spark, D.nodes(spark, (1, None, 0, 0)))))
    assert plan(left).count("SortMergeJoin") == 1 and [r["id"] for r in left.collect()] == [1]


def test_rows_are_counted_as_the_join_has_them(spark, monkeypatch):
    monkeypatch.setattr(T, "SENT", 3)
    ways = Steps(spark, "t").keep(D.ways(spark, (1, None, [1, 2]), (2, None, [1, 2])))
    joined = lambda df: plan(D.nodes(spark, (1, None, 0, 0)).join(df.select(F.explode("nodes").alias("id")), "id", "left_semi"))
    assert "Broadcast" in joined(unsent(ways)) and "Broadcast" not in joined(unsent(ways, F.size("nodes"))) and "Broadcast" not in joined(unsent(ways, rows=4))
