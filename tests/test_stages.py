from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from terravet import schemas
from terravet.functions import geometry as G
from terravet.functions.tags import Rule, Rules
from terravet.operators import apply, changesets, duplicates, export, history, ingest, locha, network
from terravet.plans.tables import Steps
from terravet.sources import osc
from tests import domain as D

B = {"a": "b"}


# --- import


def test_import_keeps_the_last_arrival_and_clears_flags(spark):
    queue = D.changes(spark, ("n", 1, 5, False, B, 1, 1, None), ("n", 2, 1, False, B, 1, 1, None)).withColumns({"targeted": F.lit(True), "cc_id": F.lit(7).cast("long")})
    batch = D.changes(spark, ("n", 1, 3, False, None, 2, 2, None), ("n", 1, 4, True, None, 2, 2, None)).drop("targeted", "locha_id", "cc_id")
    batch = batch.withColumn("insert_order", F.when(F.col("version") == 3, 2).otherwise(1))
    got = {r["id"]: (r["version"], r["targeted"], r["cc_id"]) for r in ingest.import_changes(queue, batch).collect()}
    assert got == {1: (3, False, None), 2: (1, True, 7)}


def test_deletes_of_unknown_objects_go(spark):
    queue = D.changes(spark, ("n", 1, 2, True, None, None, None, None), ("n", 2, 2, True, None, None, None, None), ("n", 3, 1, False, None, 1, 1, None))
    assert D.ids(ingest.prune_unknown_deletes(queue, D.base(spark, D.nodes(spark, (1, None, 1, 1)))), "id") == [1, 3]


# --- logical changes


def placed(spark, *points):
    """Changes at (x, y), or without place."""
    rows = [("n", i + 1, 1, False, i + 1, [], x, y) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "objtype string, id long, version int, deleted boolean, cc_id long, nodes array<long>, lon double, lat double")
    return df.withColumns({"geom": G.point(F.col("lon"), F.col("lat")), "b_geom": G.point(F.lit(None).cast("double"), F.lit(None).cast("double"))})


@pytest.mark.parametrize(
    ("points", "clusters"),
    [([(0.0, 0.0)], 1), ([(0.0, 0.0), (0.5, 0.0)], 1), ([(0.0, 0.0), (1e6, 0.0)], 2), ([(0.0, 0.0), (None, None), (None, None)], 3)],
)
def test_clusters(spark, points, clusters):
    got = locha.assign_locha(placed(spark, *points), 1.0, Steps(spark, "locha")).collect()
    assert len(got) == len(points) and len({r["locha_id"] for r in got}) == clusters


def test_a_way_and_its_node_are_glued(spark):
    rows = placed(spark, (0.0, 0.0), (50.0, 50.0)).withColumn("objtype", F.when(F.col("id") == 2, "w").otherwise("n")).withColumn("nodes", F.when(F.col("id") == 2, F.array(F.lit(1).cast("long"))))
    got = locha.assign_locha(rows, 1.0, Steps(spark, "glue")).collect()
    assert len({r["locha_id"] for r in got}) == 1


def test_ids_last_while_versions_do(spark):
    rows = placed(spark, (0.0, 0.0), (0.5, 0.0))
    one = D.ids(locha.assign_locha(rows, 1.0, Steps(spark, "a")), "id", "locha_id")
    assert one == D.ids(locha.assign_locha(rows, 1.0, Steps(spark, "b")), "id", "locha_id")
    assert one != D.ids(locha.assign_locha(rows.withColumn("version", F.lit(2)), 1.0, Steps(spark, "c")), "id", "locha_id")
    assert one[0][1] == locha.stable_id_of("n|1|1|false,n|2|1|false")


def test_large_clusters_are_split(spark):
    pts = spark.range(250).select("id", F.lit(1).cast("long").alias("cluster"), (F.col("id") % 16).cast("double").alias("x"), F.floor(F.col("id") / 16).cast("double").alias("y"))
    sizes = [r["count"] for r in locha.split_large(pts, 100.0).groupBy("part").count().collect()]
    assert max(sizes) <= 99 and sum(sizes) == 250


# --- history and links


def test_history_has_base_before_change(spark):
    base = D.base(spark, D.nodes(spark, (1, B, 1, 1)))
    queue = D.changes(spark, ("n", 1, 3, True, None, 1, 1, None)).withColumn("cc_id", F.lit(1).cast("long"))
    sets = spark.createDataFrame([(1, 2, None, "bob")], "id long, comments_count int, tags map<string,string>, user string")
    shape = lambda df: df.select("objtype", "id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    world = {"g": G.box_polygon(-180, -90, 180, 90), "none": None}
    rows = history.history(history.versions(base, queue, shape(base), shape(queue), sets, world))
    p = rows.first()["p"]
    assert [(v["version"], v["is_change"], v["group_ids"], v["changeset"]["user"]) for v in p] == [(1, False, ["g"], "bob"), (3, True, ["g"], "bob")]
    pair = history.sides(rows).first()
    assert (pair["before"]["version"], pair["after"]["version"]) == (1, 3)


def test_a_deleted_and_a_created_object_nearby_are_linked(spark):
    base = D.base(spark, D.nodes(spark, (1, B, 1, 1), (2, B, 1, 1)))
    queue = D.changes(spark, ("n", 1, 2, True, None, 1, 1, None), ("n", 3, 1, False, B, 2, 1, None), ("n", 2, 2, False, {"a": "c"}, 1, 1, None)).withColumn("cc_id", F.col("id"))
    sets = spark.createDataFrame([], "id long, comments_count int, tags map<string,string>, user string")
    shape = lambda df: df.select("objtype", "id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    pairs = history.sides(history.history(history.versions(base, queue, shape(base), shape(queue), sets, {})))
    links = history.clustered(history.conflated(pairs), Steps(spark, "links"))
    got = sorted((r["before"]["id"] if r["before"] else 0, r["after"]["id"], r["reason"]["conflate"], r["cluster"]) for r in links.collect())
    assert [g[:3] for g in got] == [(0, 3, "same"), (1, 1, "same"), (1, 3, "nearby"), (2, 2, "same")]
    by = {g[:2]: g[3] for g in got}
    assert by[0, 3] == by[1, 1] == by[1, 3] != by[2, 2]


# --- apply


def test_create_update_delete(spark):
    base, journal = D.base(spark, D.nodes(spark)), D.changes(spark)
    for version, deleted, expected in ((1, False, [1]), (2, False, [2]), (2, True, [])):
        queue = D.changes(spark, ("n", 1, version, deleted, B, 1, 1, None))
        base, queue, journal = apply.apply_changes(base, queue, journal, queue)
        base, journal = Steps(spark, "x").keep(base), Steps(spark, "y").keep(journal)
        assert D.ids(base, "version") == expected and queue.isEmpty()
    assert D.ids(journal, "version", "deleted") == [(1, False), (2, False), (2, True)]


def test_versions_beside_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    apply.set_aside(spark.range(3), path)
    old = apply.current(spark, path)
    apply.set_aside(old.union(spark.range(1)), path)
    assert (old.count(), apply.current(spark, path).count()) == (3, 4)


def test_integrity(spark):
    n, w = D.nodes(spark, (1, None, 1, 1)), D.ways(spark, (3, None, [1, 2]))
    assert D.ids(apply.missing_nodes(w, n), "way", "node") == [(3, 2)]
    assert D.ids(apply.still_referenced(n.select("id"), w), "node") == [1]
    with pytest.raises(ValueError, match="lists"):
        apply.check_empty(apply.missing_nodes(w, n), "a way lists nothing")


# --- duplicates


def found(spark, *queue, base=((1, B, 1, 0), (2, B, 0, 1))):
    rules = Rules((Rule.of("[a=b]", duplicate_distance=2.0),))
    pts = D.base(spark, D.nodes(spark, *base)).select("objtype", "id", "tags", F.col("lon").alias("x"), F.col("lat").alias("y"))
    rows = D.changes(spark, *queue).select("objtype", "id", "locha_id", "deleted", "tags", F.col("lon").alias("x"), F.col("lat").alias("y"))
    rows = rows.withColumn("locha_id", F.lit(1))
    return {r["id"]: r["duplicates"] for r in duplicates.duplicates(pts, rows, rules).collect()}


def test_duplicates(spark):
    assert found(spark, ("n", 1, 1, False, B, 1, 0, None)) == {}
    assert found(spark, ("n", 3, 1, False, B, 100, 100, None)) == {}
    assert found(spark, ("n", 3, 1, False, B, 1, 1, None)) == {3: ["n1", "n2"]}
    assert found(spark, ("n", 3, 1, False, B, 101, 100, None), ("n", 4, 1, False, B, 100, 101, None)) == {3: ["n4"], 4: ["n3"]}
    assert found(spark, ("n", 3, 1, False, B, 0, 1, None)) == {3: ["n1", "n2"]}
    assert found(spark, ("n", 1, 2, True, None, 1, 1, None)) == {}


def test_duplicates_of_moved_and_retagged_objects(spark):
    assert found(spark, ("n", 1, 2, False, None, 100, 100, None)) == {}
    assert found(spark, ("n", 1, 2, False, B, 1, 0, None), base=((1, B, 100, 100), (2, B, 0, 1))) == {1: ["n2"]}
    assert found(spark, ("n", 1, 2, False, B, 1, 0, None), base=((1, {}, 1, 0), (2, B, 0, 1))) == {1: ["n2"]}
    assert found(spark, ("n", 3, 1, False, {"a": "c"}, 1, 1, None)) == {}
    assert found(spark, ("n", 3, 1, False, B | {"level": "1"}, 1, 1, None)) == {}


# --- network


def neighbours(spark, *queue):
    n = D.nodes(spark, *[(i, None, i, i) for i in range(1, 6)])
    w = D.ways(spark, (10, None, [1, 2]), (11, None, [2, 3]), (12, None, [3, 4]), (13, None, [4, 5]))
    rows = D.changes(spark, *[("w", i, v, False, None, None, None, refs) for i, v, refs in queue]).withColumns({"targeted": F.lit(True), "locha_id": F.lit(1).cast("long")})
    one = lambda x: sorted({m["way_id"] for m in x}) if x else None
    return {r["id"]: (one(r["base_neighbors"]), one(r["change_neighbors"])) for r in network.network_diff(w, n, rows, Rules()).collect()}


def test_network(spark):
    assert neighbours(spark, (10, 2, [1, 2])) == {}
    assert neighbours(spark, (10, 2, [1, 1])) == {10: ([11], None)}
    assert neighbours(spark, (10, 2, [1, 2, 3])) == {10: ([11], [11, 12])}
    assert neighbours(spark, (13, 2, [4, 5]), (20, 1, [5, 1])) == {20: (None, [10])}
    assert neighbours(spark, (11, 2, [2, 20]), (20, 1, [20, 21]), (21, 1, [22, 3])) == {11: ([10, 12], [10]), 21: (None, [12])}


# --- export


def test_diff_file_comes_back(spark, tmp_path):
    rows = [
        ("n", 1, 1, False, {"a": 'x & "y"'}, 1.5, 2.5, None),
        ("n", 2, 3, True, None, 1, 1, None),
        ("w", 3, 2, False, {}, None, None, [1, 2, 1]),
        ("r", 4, 2, False, {"t": "r"}, None, None, None, [(3, "outer", "w"), (1, "", "n")]),
    ]
    queue = D.changes(spark, *rows)
    path = f"file://{tmp_path}/001.osc.gz"
    assert export.write_osc(queue, path)
    got = {(r["objtype"], r["id"]): r for r in osc.read_osc(spark, path).collect()}
    assert {(k, r["version"], r["deleted"]) for k, r in got.items()} == {((r[0], r[1]), r[2], r[3]) for r in rows}
    assert got["n", 1]["tags"] == {"a": 'x & "y"'} and (got["n", 1]["lon"], got["n", 1]["lat"]) == (1.5, 2.5)
    assert got["w", 3]["nodes"] == [1, 2, 1] and [tuple(m) for m in got["r", 4]["members"]][0] == (3, "outer", "w")
    assert not export.write_osc(queue.limit(0), f"file://{tmp_path}/002.osc.gz")


def test_state_file():
    s = osc.State.parse("#x\nsequenceNumber=12\ntimestamp=2024-01-01T00\\:00\\:05Z\n")
    assert s.sequence == 12 and osc.State.parse(s.text()) == s
    assert osc.State(1234567, s.timestamp).path == "001/234/567" and s.next(datetime(2024, 1, 2, tzinfo=UTC)).sequence == 13


def test_changesets_wait_longer_as_they_age(spark):
    ts = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    known = spark.createDataFrame([(1, False, ts(0), ts(0)), (2, False, ts(0), ts(30)), (3, True, ts(0), ts(30)), (4, False, ts(0), ts(20))], "id long, open boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    queue = spark.createDataFrame([("n", i, i) for i in (1, 2, 3, 4, 9)], "objtype string, id long, changeset_id int")
    got = changesets.missing(queue.limit(0).select("objtype", "id", "changeset_id"), queue, known, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    assert D.ids(got, "id") == [1, 3, 9]


def test_full_dump_is_in_order(spark, tmp_path):
    base = D.base(spark, D.nodes(spark, (2, B, 1, 1), (1, B, 1, 1)), D.ways(spark, (1, None, [1, 2])))
    export.full_dump(base, f"file://{tmp_path}/dump")
    assert sorted((r["objtype"], r["id"]) for r in spark.read.parquet(f"file://{tmp_path}/dump").collect()) == [("n", 1), ("n", 2), ("w", 1)]
    assert schemas.BASE.fieldNames() == base.columns
