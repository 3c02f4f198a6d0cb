import pytest
from pyspark.sql import functions as F

from terravet.functions.tags import Rule, Rules
from terravet.operators import validate as V

SIDE = "struct<objtype:string,id:long,version:int,deleted:boolean,created:timestamp_ntz,username:string,tags:map<string,string>,changeset:struct<comments_count:int,tags:map<string,string>>,group_ids:array<string>,geom:struct<kind:string,parts:array<array<struct<x:double,y:double>>>>>"
SCHEMA = f"locha_id long, cluster long, link long, before {SIDE}, after {SIDE}, reason struct<conflate:string,score:double,max_distance:double>, candidate boolean"


def side(tags, deleted=False, user="bob", created=None, comments=0, set_tags=None, groups=(), geom=("point", [[{"x": 0.0, "y": 0.0}]])):
    return {"objtype": "n", "id": 1, "version": 1, "deleted": deleted, "created": created, "username": user, "tags": tags, "changeset": {"comments_count": comments, "tags": set_tags}, "group_ids": list(groups), "geom": None if geom is None else {"kind": geom[0], "parts": geom[1]}}


def run(spark, before, after, *validators, dist=None):
    df = spark.createDataFrame([(1, 0, 0, before, after, {"conflate": "same", "score": 1.0, "max_distance": dist}, True)], SCHEMA)
    rows = V.diff(df)
    for v in validators:
        rows = v.apply(rows)
    r = V.link_verdict(rows).first()
    show = lambda m: {k: [(a["validator_id"], a["action"]) for a in v] for k, v in m.items()}
    return show(r["attribs"]), show(r["tags"]), r["action"]


OLD, NEW = side({"foo": "bar"}), side({"bar": "foo"})


def test_diff(spark):
    assert run(spark, OLD, NEW) == ({}, {"bar": [], "foo": []}, None)
    assert run(spark, OLD, OLD) == ({}, {}, "accept")
    assert run(spark, side({}), side({"building": "building"}))[1] == {}
    assert run(spark, None, NEW)[0] == {"deleted": []} and run(spark, OLD, None)[0] == {"deleted": []}


@pytest.mark.parametrize("verdict", ["accept", "reject"])
def test_all(spark, verdict):
    got = run(spark, OLD, NEW, V.All("all", verdict))
    assert got == ({}, {"bar": [("all", verdict)], "foo": [("all", verdict)]}, verdict)
    assert run(spark, OLD, NEW, V.All("all", verdict, block=False))[2] is None


def test_force_clears_what_was_said(spark):
    got = run(spark, OLD, NEW, V.All("a", "reject"), V.All("b", "accept", force=True))
    assert got[1] == {"bar": [("b", "accept")], "foo": [("b", "accept")]} and got[2] == "accept"
    assert run(spark, OLD, NEW, V.All("a", "reject"), V.All("b", "accept"))[2] == "reject"


def test_users_deletes_and_changesets(spark):
    assert run(spark, OLD, NEW, V.UserList("u", "accept", users=("bob",)))[2] == "accept"
    assert run(spark, OLD, NEW, V.UserList("u", "accept", users=("eve",)))[2] is None
    assert run(spark, OLD, side(None, deleted=True), V.Deleted("d"))[0] == {"deleted": [("d", "reject")]}
    assert run(spark, OLD, side({"foo": "bar"}, comments=1), V.ChangesetComment("c"))[0] == {"changeset": [("c", "reject")]}
    assert run(spark, OLD, side({"foo": "bar"}, set_tags={"review_requested": "yes"}), V.ChangesetReviewRequested("r"))[0] == {"changeset": [("r", "reject")]}


def test_delays(spark):
    import datetime as dt

    now = "2000-01-01 00:00:30"
    at = lambda s: side({"bar": "foo"}, created=dt.datetime(2000, 1, 1, 0, 0, s))
    before, after = V.Delayed("d", before_delay=10, now=now), V.Delayed("d", "accept", after_delay=10, now=now)
    assert run(spark, OLD, at(29), before)[2] == "reject" and run(spark, OLD, at(10), before)[2] is None
    assert run(spark, OLD, at(29), after)[2] is None and run(spark, OLD, at(10), after)[2] == "accept"
    with pytest.raises(ValueError, match="delay"):
        V.Delayed("d")


def test_geometry(spark):
    v = V.GeomChanges("g", dist=100.0)
    assert run(spark, OLD, OLD, v, dist=10.0)[0] == {"geom": [("g", "accept")]}
    assert run(spark, OLD, OLD, v, dist=200.0)[0] == {"geom": [("g", "reject")]}
    assert run(spark, OLD, OLD, v, dist=0.0)[0] == {} and run(spark, OLD, OLD, v)[0] == {}
    assert run(spark, OLD, side({"foo": "bar"}, geom=None), V.GeomInvalid("i"))[0] == {"geom": [("i", "reject")]}
    assert run(spark, OLD, OLD, V.GeomInvalid("i"))[0] == {}
    assert run(spark, None, NEW, V.GeomNewObject("n"))[0] == {"deleted": []}


def test_tags_of_interest(spark):
    v = V.TagsChanges("t", rules=Rules((Rule.of("[shop=florist]", interest=("phone",), sources=("s",)),)))
    got = run(spark, side({"shop": "florist"}), side({"shop": "florist", "phone": "1", "fax": "2"}), v)
    assert got[1] == {"fax": [("t", "accept")], "phone": [("t", "reject")]} and got[2] == "reject"


def test_spread(spark):
    rows = [(1, 0, 0, OLD, NEW, None, True), (1, 0, 1, OLD, OLD, None, True), (1, 1, 2, OLD, OLD, None, True), (2, 0, 3, OLD, OLD, None, True)]
    df = V.diff(spark.createDataFrame(rows, SCHEMA))
    out = V.spread(V.link_verdict(V.All("all", "reject").apply(df)))
    got = {r["link"]: (r["action"], r["cluster_action"], r["locha_action"], [a["validator_id"] for a in (r["attribs"].get("id") or [])]) for r in out.collect()}
    assert got[0] == ("reject", "reject", "reject", []) and got[1] == ("reject", "reject", "reject", ["semantic_rejection_propagation"])
    assert got[2] == ("accept", "accept", "reject", []) and got[3] == ("accept", "accept", "accept", [])


def test_gate(spark):
    rules = Rules((Rule.of("[foo]", user_groups=("g",)),))
    rows = [(1, 0, i, side({"foo": "bar"}, groups=g), NEW, None, True) for i, g in enumerate((("g",), ("h",)))]
    got = {r["link"]: (r["candidate"], r["matches"]) for r in V.gated(spark.createDataFrame(rows, SCHEMA).drop("candidate"), rules).collect()}
    assert got == {0: (True, ["[foo]"]), 1: (False, ["[foo]"])}


def test_registry(spark):
    assert isinstance(V.build("user_list", {"list": ["bob"], "action": "accept"}), V.UserList)
    v = V.build("mine", {"instance": "Validators::TagsChanges", "action_force": "accept"})
    assert isinstance(v, V.TagsChanges) and v.force and v.id == "mine"

    class Mine(V.Validator):
        def apply(self, links):
            return self.everywhere(links, F.lit(True))

    V.register("mine", Mine)
    assert run(spark, OLD, NEW, V.build("mine", {"action": "accept"}))[2] == "accept"
