"""Keyed tables against a dictionary, over random updates; what an update writes, what a reader sees, what compaction and vacuum leave."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.plans.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("n", T.IntegerType())])


def table(spark, tmp_path, bits=4):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, bits)


def rows(df):
    out = {r["id"]: (r["v"], r["n"]) for r in df.collect()}
    assert len(out) == df.count()
    return out


def frame(spark, state):
    return spark.createDataFrame([(i, *x) for i, x in state.items()], SCHEMA)


def files(t, name):
    return sum(s.getLen() for s in t.fs.listStatus(t._at(name)))


def test_updates_and_compaction_equal_a_dictionary(spark, tmp_path):
    rng, t = random.Random(3), table(spark, tmp_path)
    assert t.read().count() == 0 and t.change(frame(spark, {}).withColumn("gone", F.lit(False))) == 0 and t.manifest() is None
    state = {i: (f"a{i}", i) for i in range(-40, 200)}
    t.replace(frame(spark, state))
    assert rows(t.read()) == state
    for k in range(7):
        ids = rng.sample(range(-60, 240), 12)
        gone = set(rng.sample(ids, 4))
        new = {i: (f"u{k}", None if i % 3 else i) for i in ids}
        n = t.change(frame(spark, new).withColumn("gone", F.col("id").isin(list(gone))))
        assert n == 12
        state = {i: x for i, x in {**state, **new}.items() if i not in gone}
        assert rows(t.read()) == state
        if k in (2, 5):
            before = t.manifest()
            t.compact()
            assert t.manifest().deltas == [] and t.manifest().state == before.state and rows(t.read()) == state
    t.replace(frame(spark, {1: ("z", 1)}))
    assert rows(t.read()) == {1: ("z", 1)}


def test_an_update_writes_its_rows_only(spark, tmp_path):
    t = table(spark, tmp_path, bits=10)
    t.replace(spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n")))
    base = t.manifest().generations[0]
    whole = sum(files(t, f"{base['name']}/bucket={b}") for b in base["buckets"])
    assert t.change(spark.range(5, 8).select("id", F.lit("x").alias("v"), F.lit(2).alias("n"), F.lit(False).alias("gone"))) == 3
    m = t.manifest()
    assert m.generations == [base] and [d["rows"] for d in m.deltas] == [3] and m.deltas[0]["buckets"] == [0]
    assert files(t, m.deltas[0]["name"]) < whole / 100
    # What no delta touches is read by partition, without a join over it; compaction writes one bucket of 49.
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "NOT (bucket" in plan or "NOT bucket" in plan
    t.compact()
    m = t.manifest()
    assert [len(g["buckets"]) for g in m.generations] == [49, 1] and m.generations[0]["dead"] == [0] and m.generations[1]["counts"] == [1024]
    assert t.read().filter("v = 'x'").count() == 3 and t.read().count() == 50_000


def test_a_reader_sees_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(frame(spark, {i: ("a", i) for i in range(100)}))
    t.change(frame(spark, {5: ("b", 5), 6: ("b", 6)}).withColumn("gone", F.lit(False)))
    old, number = t.read(), t.manifest().number
    t.compact()
    t.change(frame(spark, {5: ("c", 5), 7: ("c", 7)}).withColumn("gone", F.col("id") == 7))
    assert rows(old)[5] == ("b", 5) and len(rows(old)) == 100 and rows(t.read(number)) == rows(old)
    assert rows(t.read())[5] == ("c", 5) and 7 not in rows(t.read())
    # A generation that was written but isn't named yet changes nothing, and vacuum takes it.
    lost = t._write(frame(spark, {1: ("lost", 1)}), 4)
    assert rows(t.read())[1] == ("a", 1)
    t.vacuum(keep=1)
    assert not t.fs.exists(t._at(lost["name"])) and rows(t.read())[5] == ("c", 5) and t._numbers() == [t.manifest().number]


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(frame(spark, {1: ("a", 1)}))
    one, two = t.manifest(), t.manifest()
    t._publish(one)
    with pytest.raises(RuntimeError, match="meanwhile"):
        t._publish(two)
    assert rows(t.read()) == {1: ("a", 1)}


def test_compaction_is_due_and_merges_generations(spark, tmp_path, monkeypatch):
    from terravet.plans import keyed

    monkeypatch.setattr(keyed, "GENERATIONS", 2)
    t, state = table(spark, tmp_path), {i: ("a", i) for i in range(300)}
    t.replace(frame(spark, state))
    assert not t.due()
    for k in range(4):
        new = {i: (f"k{k}", i) for i in range(40 * k, 40 * k + 40)}
        t.change(frame(spark, new).withColumn("gone", F.lit(False)))
        state |= new
        assert t.due()
        t.compact()
        assert rows(t.read()) == state
    assert len(t.manifest().generations) <= 4
