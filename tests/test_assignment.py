"""Partners of deleted and created objects against a plain stable matching; similarity of tags."""

import random

import pytest
from pyspark.sql import functions as F

from terravet.operators import history
from terravet.plans.tables import Steps
from terravet.sources import pbf


def plain(rows):
    taken, out = set(), set()
    for g, x, y, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if ("x", g, x) not in taken and ("y", g, y) not in taken:
            taken |= {("x", g, x), ("y", g, y)}
            out.add((g, x, y, s))
    return out


@pytest.mark.parametrize("scores", [3, 1000])
def test_random_sets(spark, scores):
    rng = random.Random(scores)
    rows = {(g, x, y): rng.randint(0, scores) / scores for g in range(8) for x in range(9) for y in range(7) if rng.random() < 0.5}
    rows = [(*k, s) for k, s in rows.items()]
    df = spark.createDataFrame(rows, "g long, x long, y long, score double")
    got = {tuple(r) for r in history.assignment(df, ["g"], Steps(spark, "t")).select("g", "x", "y", "score").collect()}
    assert got == plain(rows)
    score = {r[:3]: r[3] for r in rows}
    mine = {("x", g, x): s for g, x, _, s in got} | {("y", g, y): s for g, _, y, s in got}
    # Stable: no pair that both would rather have.
    assert not [k for k, s in score.items() if s > mine.get(("x", k[0], k[1]), -1) and s > mine.get(("y", k[0], k[2]), -1)]


def test_none(spark):
    df = spark.createDataFrame([], "g long, x long, y long, score double")
    assert history.assignment(df, ["g"], Steps(spark, "t")).count() == 0


def test_similarity_of_tags(spark):
    rows = [({"a": "x"}, {"a": "x"}, 1.0), ({"a": "main street"}, {"a": "main streat"}, 1 - 1 / 11), ({"a": "x"}, {"b": "x"}, 0.0), ({"a": "x", "b": "y"}, {"a": "x"}, 0.5), (None, {}, 0.0), ({"a": ""}, {"a": ""}, 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a map<string,string>, b map<string,string>")
    got = {r["i"]: r["s"] for r in df.select("i", history.tag_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx([r[2] for r in rows])


def test_paths_as_spark_takes_them(tmp_path):
    assert pbf.opened(str(tmp_path))[1] == pbf.opened(f"file://{tmp_path}")[1] == str(tmp_path)
    assert pbf.uri_of("s3a://bucket/a/b.osm.pbf") == "s3://bucket/a/b.osm.pbf" and pbf.uri_of("hdfs://host/a") == "hdfs://host/a"
    with pytest.raises(ValueError):
        pbf.opened("file://a/b")
