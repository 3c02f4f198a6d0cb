"""Twins of changed objects against plain loops over pairs; no pair is shuffled."""

import re

from pyspark.sql import functions as F

from terravet.functions.tags import Rule, Rules
from terravet.operators import duplicates
from tests.test_duplicate_places import ROW, close, rows


def test_against_loops(spark):
    pool, some = rows(150, 3), rows(150, 3)[:60]
    pool[100] = ("w", 3, *pool[3][2:])
    pool[101] = (*pool[3][:2], (pool[3][2] + 1) % 4, *pool[3][3:])
    pool[102] = ("n", 102, pool[3][2], pool[3][3], pool[3][4], pool[3][5], -0.0, pool[3][7])
    got = duplicates.twins(spark.createDataFrame(some, ROW).withColumn("had", F.col("id") + 1), spark.createDataFrame(pool, ROW), ["had"])
    want = {}
    for x in some:
        names = [f"{t}{i}" for t, i in sorted(y[:2] for y in pool if close(x, y) and x[2] == y[2] and x[:2] != y[:2])]
        if names:
            want[x[1]] = (x[2], x[3], x[1] + 1, len(names), names)
    assert {r["id"]: (r["locha_id"], r["index"], r["had"], r["count"], r["duplicates"]) for r in got.collect()} == want and len(want) > 20


def test_pairs_are_not_shuffled(spark):
    """300 objects in one place: 90,000 names in the result, and no shuffle of more than a row for each object and cell around."""
    df = spark.range(300).select(F.lit("n").alias("objtype"), "id", F.lit(0).alias("index"), F.lit(1).alias("locha_id"), F.lit(None).cast("string").alias("level"), F.lit(2.0).alias("distance"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")).repartition(3)
    got = duplicates.change_twins(df.limit(0), df.limit(0), df)
    assert got.select(F.sum("count")).first()[0] == 300 * 299
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Sort" not in re.sub("sort_array", "", above)


def test_what_an_object_had_goes_with_it(spark):
    """The names are made last: above them stands no join and no aggregation, whose shuffle would carry them."""
    rules = Rules((Rule.of("[a]", duplicate_distance=2.0),))
    kind = "objtype string, id long, tags map<string,string>, x double, y double"
    base = spark.createDataFrame([("n", i, {"a": "1"}, x, 0.0) for i, x in ((1, 0.0), (2, 1.0), (3, 2.5), (9, 50.0))], kind)
    moved = [("n", 1, {"a": "1"}, 0.5, 0.0), ("n", 3, {"a": "1"}, 30.0, 0.0), ("n", 7, {"a": "1"}, 1.0, 1.0), ("n", 8, {"b": "1"}, 1.0, 1.0)]
    changes = spark.createDataFrame(moved, kind).withColumns({"locha_id": F.lit(4), "deleted": F.lit(False)})
    got = {strict: duplicates.duplicates(base, changes, rules, strict) for strict in (False, True)}
    told = {strict: {r["id"]: r["duplicates"] for r in df.collect()} for strict, df in got.items()}
    assert told == {False: {7: ["n1", "n2"], 1: ["n1"]}, True: {7: ["n1", "n2"], 1: ["n2", "n7"]}}
    plan = got[True]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(own")]
    assert "Join" not in above and "Aggregate" not in above
