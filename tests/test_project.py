"""Whole updates: one batch, a stream, the configuration files, the query language."""

import json
from datetime import UTC, datetime

import pytest

from terravet.functions import overpass
from terravet.plans.project import Project
from terravet.sources import config, osc
from terravet.streaming import micro_batch
from tests import domain as D

NOW = datetime(2024, 1, 1, tzinfo=UTC)


def project(spark, settings):
    p = Project(spark, f"file://{settings}/data", config.load(settings / "demo/config.yaml"))
    n = D.nodes(spark, (1, {"a": "1", "name": "x"}, 0, 0), (2, {"b": "1"}, 50, 50), (3, {"a": "1"}, -50, -50))
    p.put(nodes=n, ways=D.ways(spark, (10, {"w": "1"}, [2, 3])), relations=D.relations(spark))
    return p


def rows(spark):
    """A tag of interest, something of no interest, a delete, and a move with a harmless tag."""
    q = D.changes(
        spark, ("n", 1, 2, False, {"a": "1", "name": "y"}, 0, 0, None), ("n", 4, 1, False, {"c": "1"}, 80, 80, None), ("n", 99, 2, True, None, None, None, None), ("n", 3, 2, False, {"a": "1", "k": "v"}, -50, -50.5, None)
    )
    return q.drop("targeted", "locha_id", "cc_id")


def state(p):
    nodes = {r["id"]: r["version"] for r in p.table("nodes").collect()}
    return nodes, D.ids(p.table("queue"), "id"), sorted((r["after_object"]["id"], r["action"]) for r in p.table("log").collect())


def test_one_update_and_a_stream_agree(spark, settings, tmp_path_factory):
    p = project(spark, settings)
    p.update(rows(spark).withColumn("insert_order", osc.F.lit(0)), None, NOW)
    nodes, queue, log = state(p)
    assert nodes == {1: 1, 2: 1, 3: 2, 4: 1} and queue == [1] and log == [(1, "reject"), (3, "accept")]
    out = {(r["objtype"], r["id"]) for r in osc.read_osc(spark, f"{p.folder}/export/000/000/001.osc.gz").collect()}
    assert ("n", 4) in out and ("n", 1) not in out and p.table("journal").isEmpty()
    assert p.changes_logs().count() >= 1 and "<feed" in p.atom("http://example.org")
    assert p.listing().first()["pending"] >= 1
    p.check_integrity()
    # by hand
    p.accept(p.table("log").filter("after_object.id = 1").select("locha_id"), 7)
    assert {r["id"]: r["version"] for r in p.table("nodes").collect()}[1] == 2 and 1 not in D.ids(p.table("queue"), "id")

    other = tmp_path_factory.mktemp("stream")
    (other / "demo").mkdir()
    for f in ("common.yaml", "demo/world.geojson", "demo/tags.json", "demo/config.yaml"):
        (other / f).write_text((settings / f).read_text())
    q = project(spark, other)
    rows(spark).withColumn("sequence", osc.F.lit(1).cast("long")).write.parquet(f"file://{other}/in/1", mode="overwrite")
    micro_batch.start(q, f"file://{other}/in/*", f"file://{other}/checkpoint", now=lambda: NOW).awaitTermination()
    assert state(q)[0] == nodes and state(q)[1] == queue and state(q)[2] == log


def test_configuration(settings):
    c = config.load(settings / "demo/config.yaml")
    assert c.description == {"en": "d"} and c.rules.rules[0].user_groups == ("all",) and c.polygons and list(c.validators) == ["deleted", "tags_changes"]
    assert list(config.projects(settings)) == ["demo"]
    (settings / "demo/config.yaml").write_text("title: {en: x}\n")
    with pytest.raises(ValueError, match="lacks"):
        config.load(settings / "demo/config.yaml")
    with pytest.raises(ValueError, match="unknown keys"):
        config.rule_of({"select": ["[a]"], "odd": 1})


def test_query_language(spark, settings):
    p = project(spark, settings)
    run = lambda q: [json.loads(r["j"]) for r in p.overpass(q).collect()]
    ids = lambda q: sorted((x["type"], x["id"]) for x in run(q))
    assert ids("[out:json];node[a];out ids;") == [("node", 1), ("node", 3)]
    assert ids("node[a](-10,-10,10,10);out;") == [("node", 1)]
    assert ids("node(around:1000,0.001,0.001);out;") == [("node", 1)]
    assert ids("way(10);(._;>;);out ids;") == [("node", 2), ("node", 3), ("way", 10)]
    assert ids("(node[b];way[w];)->.x;.x out ids;") == [("node", 2), ("way", 10)]
    assert ids("node(3);<;out ids;") == [("way", 10)]
    assert run("node[a];out count;") == [{"type": "count", "total": 2}]
    assert run("node(1);out;")[0]["tags"] == {"a": "1", "name": "x"}
    for bad in ("node[a", "node[a];", "out(", "what;", "node(1,2,3);out;"):
        with pytest.raises(ValueError):
            overpass.query(p.base.limit(0).withColumn("geom", osc.F.lit(None).cast("struct<kind:string,parts:array<array<struct<x:double,y:double>>>>")), bad)


def test_delays_hang_on_the_time_of_the_update(spark, settings):
    """A change of half a year before: with both delays named only the later one speaks, and only once it is so old."""
    text = (settings / "demo/config.yaml").read_text()
    said = {}
    for days in (10, 400):
        (settings / "demo/config.yaml").write_text(text.replace("  deleted: {}\n  tags_changes: {}\n", f"  late: {{instance: Delayed, after_delay: {days * 86400}, action: accept}}\n  early: {{instance: Delayed, before_delay: {days * 86400}, action: reject}}\n"))
        p = project(spark, settings)
        p.put(queue=p.table("queue").limit(0), log=p.table("log").limit(0), journal=p.table("journal").limit(0))
        when = osc.F.lit(datetime(2023, 7, 1)).cast("timestamp_ntz")
        p.update(rows(spark).withColumn("created", when).withColumn("insert_order", osc.F.lit(0)), None, NOW)
        said[days] = {r["after_object"]["id"]: r["action"] for r in p.table("log").collect()}
    assert said[10][1] == "accept" and said[400][1] == "reject"


def test_distances_are_metres(spark, settings):
    """A move of some 110 m in UTM zone 31: within 200 m, beyond 50 m; and a deleted and a created node some 50 km apart are no one object."""
    text = (settings / "demo/config.yaml").read_text().replace("local_srid: 4326", "local_srid: 32631")
    for dist, verdict in ((200, "accept"), (50, "reject")):
        (settings / "demo/config.yaml").write_text(text.replace("  deleted: {}\n  tags_changes: {}\n", f"  moved: {{instance: GeomChanges, dist: {dist}, accept: moved_little, reject: moved_far}}\n"))
        p = Project(spark, f"file://{settings}/metres{dist}", config.load(settings / "demo/config.yaml"))
        p.put(nodes=D.nodes(spark, (1, {"a": "1"}, 3.0, 45.0), (2, {"a": "1", "name": "x"}, 3.0, 45.5)), ways=D.ways(spark), relations=D.relations(spark))
        q = D.changes(spark, ("n", 1, 2, False, {"a": "1"}, 3.0, 45.001, None), ("n", 2, 2, True, None, 3.0, 45.5, None), ("n", 7, 1, False, {"a": "1", "name": "x"}, 3.0, 45.95, None)).drop("targeted", "locha_id", "cc_id")
        p.update(q.withColumn("insert_order", osc.F.lit(0)), None, NOW)
        log = p.table("log").collect()
        (moved,) = [r for r in log if r["after_object"]["id"] == 1]
        (said,) = moved["diff_attribs"]["geom"]
        assert (said["validator_id"], said["action"]) == (f"moved_{'little' if verdict == 'accept' else 'far'}", verdict) and 100 < float(said["options"]["dist"]) < 120
        assert not [r for r in log if r["before_object"] is not None and r["before_object"]["id"] == 2 and r["after_object"]["id"] == 7]


def test_names_of_verdicts_belong_to_two_sided_validators(settings):
    from terravet.operators import validate

    assert validate.build("geom_changes", {"dist": 3, "accept": "a", "reject": "b"}).accept == "a"
    with pytest.raises(ValueError, match="name the two verdicts"):
        validate.build("deleted", {"accept": "a"})
