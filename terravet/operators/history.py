"""Versions of objects side by side, and their links from before to after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.operators import nearby
from terravet.operators.graph import components, packed
from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY

#: Deleted and created objects may be one if they are no further apart; from conflation's own definition.
REACH = 200.0
STATE = ["objtype", "id", "version", "deleted", "created", "username", "tags", "nodes", "members", "geom", "changeset", "group_ids", "cc_id", "is_change"]


def in_groups(geom: Column, groups: dict[str, list | None], global_groups: bool = False) -> Column:
    """Names of the user groups whose polygon a geometry meets. A group without polygon has no members, or with global_groups all."""
    parts = []
    for name, polygons in groups.items():
        if polygons is None:
            parts += [F.lit(name)] if global_groups else []
        else:
            parts.append(F.when(G.intersects_polygons(polygons)(geom), F.lit(name)))
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")


def versions(base: DataFrame, queue: DataFrame, base_geom: DataFrame, change_geom: DataFrame, changesets: DataFrame, groups: dict[str, list | None], global_groups: bool = False) -> DataFrame:
    """A row for each version (STATE and locha_id): the pending changes, and the base rows that they replace."""
    keys = queue.select(*OBJECT_KEY, "locha_id", "cc_id")
    old = base.drop("locha_id", "cc_id").join(keys, OBJECT_KEY).join(base_geom, OBJECT_KEY, "left").withColumns({"deleted": F.lit(False), "is_change": F.lit(False)})
    new = queue.join(change_geom, OBJECT_KEY, "left").withColumn("is_change", F.lit(True))
    cols = ["locha_id", "objtype", "id", "version", "deleted", "created", "username", "tags", "nodes", "members", "geom", "cc_id", "is_change", "changeset_id"]
    rows = old.select(cols).unionByName(new.select(cols))
    sets = changesets.select(F.col("id").cast("int").alias("changeset_id"), F.struct(F.col("id").alias("id"), "comments_count", F.col("tags").alias("tags"), "user").alias("changeset"))
    return rows.join(sets, "changeset_id", "left").withColumn("group_ids", in_groups(F.col("geom"), groups, global_groups)).select("locha_id", *STATE)


def history(rows: DataFrame) -> DataFrame:
    """(locha_id, objtype, id, p): the versions of each object, base before change."""
    lists = rows.groupBy("locha_id", *OBJECT_KEY).agg(F.collect_list(F.struct(*STATE)).alias("p"))
    order = lambda a, b: F.when(a["is_change"] == b["is_change"], a["version"] - b["version"]).when(b["is_change"], -1).otherwise(1)
    return lists.withColumn("p", F.array_sort("p", order))


def sides(rows: DataFrame) -> DataFrame:
    """(locha_id, objtype, id, before, after) of history rows: before is the base's version, after the change's."""
    before = F.get(F.filter("p", lambda v: ~v["is_change"]), F.lit(0))
    after = F.get(F.filter("p", lambda v: v["is_change"]), F.size(F.filter("p", lambda v: v["is_change"])) - 1)
    return rows.select("locha_id", *OBJECT_KEY, before.alias("before"), after.alias("after"))


def value_similarity(a: Column, b: Column) -> Column:
    """1 for equal values, else the share of letters that edits leave; 0 if one is missing."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tag_similarity(a: Column, b: Column) -> Column:
    """The mean similarity of the values over all keys of both; 0 without any."""
    x, y = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (a, b))
    keys = F.array_union(F.map_keys(x), F.map_keys(y))
    each = F.transform(keys, lambda k: value_similarity(F.try_element_at(x, k), F.try_element_at(y, k)))
    return F.when(F.size(keys) > 0, F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(keys)).otherwise(F.lit(0.0))


def assignment(pairs: DataFrame, within: list[str], steps: Steps) -> DataFrame:
    """Those of pairs (within, x, y, score and more) that a stable matching takes: no x and y would both rather have each other than what they have.

    Higher scores are better, ties go to the smaller x, then y. Each round takes the pairs that are both sides' best and leaves out
    their sides; the best pair of all that are left is always one, so every round takes some.
    """
    order = [F.desc("score"), F.col("x"), F.col("y")]
    best = lambda side: F.row_number().over(Window.partitionBy(*within, side).orderBy(*order))
    left, taken = steps.keep(pairs), []
    while not left.isEmpty():
        ranked = left.withColumns({"__x": best("x"), "__y": best("y")})
        now = steps.keep(ranked.filter("__x = 1 AND __y = 1").drop("__x", "__y"))
        taken.append(now)
        free = left.join(now.select(*within, "x"), [*within, "x"], "left_anti").join(now.select(*within, "y"), [*within, "y"], "left_anti")
        left = steps.keep(free.select(pairs.columns))
    return reduce(DataFrame.unionByName, taken) if taken else left


def conflated(pairs: DataFrame, reach: float = REACH, projection: G.Projection | None = None, steps: Steps | None = None) -> DataFrame:
    """Links (locha_id, before, after, reason) from sides.

    An object is linked with itself. Deleted and created ones of the same type and logical change within `reach` are linked
    besides, by a stable matching on their scores, so that each has one partner at most; the deleted one's own link stays. The
    score is the mean of the tags' similarity and 1 - distance / reach, which the reason gives one by one. This is our
    own definition. Distances are in the projection's plane.
    """
    plane, steps = (projection or G.Projection()).geometry, steps or Steps(pairs.sparkSession, "conflated")
    none, part = F.lit(None).cast("double"), "struct<score:double,reason:string>"
    reason = lambda why, score, dist, geom, tags: F.struct(F.lit(why).alias("conflate"), score.alias("score"), dist.alias("max_distance"), geom.cast(part).alias("geom"), tags.cast(part).alias("tags"))
    moved = F.when(F.col("before.geom").isNotNull() & F.col("after.geom").isNotNull(), G.geometry_distance(plane(F.col("before.geom")), plane(F.col("after.geom"))))
    own = pairs.select("locha_id", "before", "after", reason("same", F.lit(1.0), moved, F.lit(None), F.lit(None)).alias("reason"))
    gone = pairs.filter("before IS NOT NULL AND after.deleted AND before.geom IS NOT NULL").select("locha_id", "objtype", F.col("before").alias("b"))
    made = pairs.filter("before IS NULL AND NOT after.deleted AND after.geom IS NOT NULL").select("locha_id", "objtype", F.col("after").alias("a"))
    # Nearness first, by cells; then what both sides are. Types are kept apart, so ids name the objects.
    within = ["locha_id", "objtype"]
    shapes = lambda df, c: df.select(*within, F.col(f"{c}.id").alias("id"), plane(F.col(f"{c}.geom")).alias("geom"))
    pairs_ = nearby.near(shapes(gone, "b"), shapes(made, "a"), within, reach, steps)
    met = pairs_.join(gone.withColumn("id", F.col("b.id")), [*within, "id"]).join(made.withColumn("o_id", F.col("a.id")), [*within, "o_id"])
    met = met.withColumn("d", G.geometry_distance(plane(F.col("b.geom")), plane(F.col("a.geom"))))
    met = met.select(*within, F.col("id").alias("x"), F.col("o_id").alias("y"), "d", (1 - F.col("d") / reach).alias("near"), tag_similarity(F.col("b.tags"), F.col("a.tags")).alias("alike"))
    chosen = assignment(met.withColumn("score", (F.col("alike") + F.col("near")) / 2), within, steps)
    linked = chosen.join(gone.withColumn("x", F.col("b.id")), [*within, "x"]).join(made.withColumn("y", F.col("a.id")), [*within, "y"])
    said = lambda score, why: F.struct(F.col(score).alias("score"), F.lit(why).alias("reason"))
    why = reason("nearby", F.col("score"), F.col("d"), said("near", "distance"), said("alike", "tags"))
    return own.unionByName(linked.select("locha_id", F.col("b").alias("before"), F.col("a").alias("after"), why.alias("reason")))


def clustered(links: DataFrame, steps: Steps) -> DataFrame:
    """links with cluster and link: clusters are the links of a logical change whose sides share a component, numbered from 0."""
    links = steps.keep(links)
    side = lambda s: F.when(F.col(s).isNotNull(), F.coalesce(F.col(f"{s}.cc_id"), packed(F.col(f"{s}.objtype"), F.col(f"{s}.id"))))
    pairs = links.select("locha_id", side("before").alias("x"), side("after").alias("y"))
    joined = pairs.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(joined, steps)
    key = F.coalesce(side("after"), side("before"))
    named = links.withColumn("__v", key).join(found.select(F.col("v").alias("__v"), "component"), "__v", "left").withColumn("__c", F.coalesce("component", "__v")).drop("__v", "component")
    order = Window.partitionBy("locha_id")
    state = F.coalesce(F.col("after.id"), F.col("before.id"))
    ranked = named.withColumn("cluster", (F.dense_rank().over(order.orderBy("__c")) - 1).cast("long"))
    return ranked.withColumn("link", (F.row_number().over(order.orderBy("__c", F.coalesce("after.objtype", "before.objtype"), state, F.col("before.id").asc_nulls_first())) - 1).cast("long")).drop("__c")
