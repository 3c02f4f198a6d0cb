"""Propagation through references, and connected components of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.operators.apply import current, forget, set_aside
from terravet.plans.keyed import KeyedTable
from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY

#: Links that one task puts together at the end.
AT_ONCE = 50_000
LABELS = T.StructType([T.StructField("id", T.LongType()), T.StructField("component", T.LongType())])

#: Codes of vertex kinds in a packed key; the last stands for a node id that ways share.
CODES = {"n": 0, "w": 1, "r": 2, "shared": 3}


def packed(objtype: Column, id_: Column) -> Column:
    """One long for (objtype, id); ids have to be below 2^61 in size. The order is that of ids, then n, w, r."""
    code = F.when(objtype == "n", 0).when(objtype == "w", 1).otherwise(2)
    return id_ * 4 + code


def members_of(changes: DataFrame) -> DataFrame:
    """(id, type, ref): each relation change and the pending changes among its members."""
    edges = changes.filter("objtype = 'r'").select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("type"), F.col("m.ref").alias("ref")).distinct()
    return edges.join(changes.select(F.col("objtype").alias("type"), F.col("id").alias("ref")), ["type", "ref"], "left_semi")


def new_references(changes: DataFrame) -> DataFrame:
    """(objtype, id) of new objects that a changed way or relation refers to. changes: also new boolean."""
    by_way = changes.filter("objtype = 'w'").select(F.lit("n").alias("objtype"), F.explode("nodes").alias("id"))
    by_relation = changes.filter("objtype = 'r'").select(F.explode("members").alias("m")).filter("m.type IN ('n', 'w')").select(F.col("m.type").alias("objtype"), F.col("m.ref").alias("id"))
    return changes.filter("new AND objtype IN ('n', 'w')").select(*OBJECT_KEY).join(by_way.union(by_relation).distinct(), OBJECT_KEY, "left_semi")


def propagated(changes: DataFrame, steps: Steps | None = None) -> DataFrame:
    """changes with propa: deleted ones, new ones that are referred to, ways with such a node, relations with such a member.

    changes: objtype, id, deleted, new, nodes and members (before and after together). Each pass names what it is given
    several times, so its result is kept for the next.
    """
    steps = steps or Steps(changes.sparkSession, "propagated")
    changes = steps.keep(changes)
    marked = new_references(changes).withColumn("m", F.lit(True))
    first = changes.join(marked, OBJECT_KEY, "left").withColumn("propa", F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce("m", F.lit(False))).drop("m")
    return forward_to_relations(steps.keep(forward_to_ways(steps.keep(first))))


def forward_to_ways(changes: DataFrame) -> DataFrame:
    """propa of nodes passed on to the ways that list them."""
    nodes = changes.filter("objtype = 'n' AND propa").select(F.col("id").alias("ref"))
    ways = changes.filter("objtype = 'w'").select("objtype", "id", F.explode("nodes").alias("ref")).join(nodes, "ref", "left_semi").select(*OBJECT_KEY).distinct().withColumn("m", F.lit(True))
    return changes.join(ways, OBJECT_KEY, "left").withColumn("propa", F.col("propa") | F.coalesce("m", F.lit(False))).drop("m")


def forward_to_relations(changes: DataFrame) -> DataFrame:
    """propa of members passed on to relations, once."""
    hot = changes.filter("propa").select(F.col("objtype").alias("type"), F.col("id").alias("ref"))
    rel = changes.filter("objtype = 'r'").select("objtype", "id", F.explode("members").alias("m")).select("objtype", "id", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"))
    rel = rel.join(hot, ["type", "ref"], "left_semi").select(*OBJECT_KEY).distinct().withColumn("m", F.lit(True))
    return changes.join(rel, OBJECT_KEY, "left").withColumn("propa", F.col("propa") | F.coalesce("m", F.lit(False))).drop("m")


def edges(changes: DataFrame) -> DataFrame:
    """(a, b) of packed keys: what may carry interest between changes.

    changes: objtype, id, nodes, members, active, eligible, geom_changed. An end is eligible if active or changed in
    geometry; of each edge one end is active and the other eligible. Ways that share a node meet at a vertex of that node,
    if one of them is active, so that a node of many ways gives as many edges as ways, not pairs.
    """
    state = changes.filter("eligible").select("objtype", "id", packed(F.col("objtype"), F.col("id")).alias("v"), "active")
    ways = changes.filter("objtype = 'w' AND eligible").select(packed(F.col("objtype"), F.col("id")).alias("w"), F.col("active").alias("w_active"), F.explode(F.array_distinct("nodes")).alias("node")).filter("node IS NOT NULL")
    nodes = state.filter("objtype = 'n'").select(F.col("id").alias("node"), F.col("v").alias("n"), F.col("active").alias("n_active"))
    to_nodes = ways.join(nodes, "node").filter("w_active OR n_active").select(F.col("w").alias("a"), F.col("n").alias("b"))
    hot = ways.filter("w_active").select("node").distinct()
    shared = ways.join(hot, "node", "left_semi").select(F.col("w").alias("a"), (F.col("node") * 4 + CODES["shared"]).alias("b"))
    rel = changes.filter("objtype = 'r' AND geom_changed AND eligible").select(packed(F.col("objtype"), F.col("id")).alias("r"), F.col("active").alias("r_active"), F.explode("members").alias("m"))
    rel = rel.filter("m.type IN ('n', 'w')").select("r", "r_active", F.col("m.type").alias("objtype"), F.col("m.ref").alias("id")).distinct()
    to_members = rel.join(state, OBJECT_KEY).filter("r_active OR active").select(F.col("r").alias("a"), F.col("v").alias("b"))
    return to_nodes.union(shared).union(to_members)


def joined_at_once(links: DataFrame) -> DataFrame:
    """(v, to): the least end that the links (a, b), at most AT_ONCE of them, lead to; in one task, by union and find."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        if up:
            yield pd.DataFrame({"v": list(up), "to": [find(v) for v in up]})

    return links.select("a", "b").coalesce(1).mapInPandas(run, "v long, to long")


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(v, component): the smallest key that links (a, b) lead to from each of their ends.

    Each round every vertex follows the neighbour (or itself) with the least hash, the vertices that meet become one, and
    the links between what is left go on; the hash changes with the round, so that long chains shrink by a share each time. Once
    no more than AT_ONCE links are left, one task ends it.
    """
    open_ = steps.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = open_.select(F.col("a").alias("v")).union(open_.select("b")).distinct()
    rest, maps = steps.keep(open_.filter("a <> b")), []
    while left := rest.count():
        if left <= AT_ONCE:
            maps.append(steps.keep(joined_at_once(rest)))
            break
        rank = lambda c, k=len(maps): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("w")).union(rest.select("b", "a"))
        step = steps.keep(both.groupBy("v").agg(F.least(F.min(rank("v")), F.min(rank("w")))["v"].alias("to")))
        maps.append(step)
        x, y = step.select(F.col("v").alias("a"), F.col("to").alias("x")), step.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = rest.join(x, "a").join(y, "b").filter("x <> y")
        rest = steps.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return ends.select("v", F.col("v").alias("component"))
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("v").alias("to"), F.col("to").alias("end"))
        whole = steps.keep(maps.pop().join(later, "to", "left").select("v", F.coalesce("end", "to").alias("to")))
    least = whole.groupBy("to").agg(F.least(F.min("v"), F.col("to")).alias("least"))
    named = whole.join(least, "to").select("v", F.col("least").alias("component"))
    return ends.join(named, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def relabelled(labels: DataFrame, links: DataFrame, changed: DataFrame, steps: Steps) -> DataFrame:
    """(v, component, gone): the labels that change when links change, from the labels (v, component) before.

    links: (a, b) as they are now, labels of all their ends as they were. changed: (a, b) of the links added and removed. Only components that
    hold an end of these are computed again, from the links that they have now; what hangs together no more falls apart,
    and an end that no link has any more is gone. Where nothing changed the result has no rows.
    """
    ends = lambda df: df.select(F.col("a").alias("v")).union(df.select("b")).distinct()
    hit = steps.keep(ends(changed))
    old = steps.keep(labels.join(labels.join(hit, "v", "left_semi").select("component").distinct(), "component", "left_semi").select("v", "component"))
    within = steps.keep(old.select("v").union(hit).distinct())
    own = links.join(within.withColumnRenamed("v", "a"), "a", "left_semi")
    new = steps.keep(components(steps.keep(own), steps))
    both = old.join(new.select("v", F.col("component").alias("now")), "v", "full")
    moved = both.filter("NOT (component <=> now)")
    return moved.select("v", F.coalesce("now", "component").alias("component"), F.col("now").isNull().alias("gone"))


class KeptComponents:
    """Labels of a link table that are kept between updates: a keyed table, to which an update adds the labels that change."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = KeyedTable(spark, f"{folder}/labels", LABELS)
        self.links = f"{folder}/links"

    def labels(self) -> DataFrame:
        return self.table.read().select(F.col("id").alias("v"), "component")

    def update(self, links: DataFrame, steps: Steps) -> int:
        """Labels of these links in place of those before; how many labels changed.

        What changed is told by comparison with the links of the last update. The labels are written before the links: a run that
        is lost between finds the same difference again, and labels that are right already don't change.
        """
        spark = links.sparkSession
        now = steps.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        before = current(spark, self.links)
        before = now.limit(0) if before is None else before
        changed = steps.keep(now.join(before, ["a", "b"], "left_anti").union(before.join(now, ["a", "b"], "left_anti")))
        if changed.isEmpty():
            return 0
        rows = relabelled(self.labels(), now, changed, steps)
        n = self.table.change(rows.select(F.col("v").alias("id"), "component", "gone"))
        if self.table.due():
            self.table.compact()
        set_aside(now, self.links)
        forget(spark, self.links)
        return n


def change_components(changes: DataFrame, steps: Steps, kept: KeptComponents | None = None) -> DataFrame:
    """(objtype, id, cc_id): the smallest packed key of a change's component; one that nothing touches is alone.

    kept: labels of the last update's links, to compute only what changed since.
    """
    if kept is None:
        found = components(edges(changes), steps)
    else:
        kept.update(edges(changes), steps)
        found = kept.labels()
    own = changes.select(*OBJECT_KEY, packed(F.col("objtype"), F.col("id")).alias("v"))
    inside = found.join(own, "v")
    # A component is named by a change, not by a shared node.
    name = inside.groupBy("component").agg(F.min("v").alias("cc_id"))
    named = inside.join(name, "component").select("v", "cc_id")
    return own.join(named, "v", "left").select(*OBJECT_KEY, F.coalesce("cc_id", "v").alias("cc_id"))


def histogram(components_: DataFrame, n: int = 10) -> DataFrame:
    """The n largest components, ties by id."""
    return components_.groupBy("cc_id").agg(F.count(F.lit(1)).alias("objects")).orderBy(F.desc("objects"), "cc_id").limit(n)


def broken_invariants(changes: DataFrame, components_: DataFrame) -> DataFrame:
    """Pairs of an active object and an eligible one that refer to each other but have different components; none is right."""
    named = changes.join(components_, OBJECT_KEY)
    node = named.filter("objtype = 'n' AND eligible").select(F.col("id").alias("ref"), F.col("cc_id").alias("n_cc"), F.col("active").alias("n_active"))
    way = named.filter("objtype = 'w' AND eligible").select("id", "cc_id", "active", F.explode("nodes").alias("ref"))
    pairs = way.join(node, "ref").filter("(active OR n_active) AND cc_id <> n_cc")
    return pairs.select(F.col("id").alias("way"), F.col("ref").alias("node"))
