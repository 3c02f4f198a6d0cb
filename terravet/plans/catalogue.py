"""The registered queries of the engine and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravet import schemas
from terravet.functions import geometry as G
from terravet.functions import overpass, polygons, scalars
from terravet.functions.tags import Rule, Rules
from terravet.operators import apply, changesets, duplicates, export, graph, history, ingest, locha, network, review, shapes, target, validate, views
from terravet.plans.geometries import Geometries
from terravet.plans.keyed import KeyedTable
from terravet.plans import split_sql
from terravet.plans.prelude import sql
from terravet.plans.tables import Steps
from terravet.sources.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Selectors of the registered queries.
BRAND = Rule.of('[brand="Brand#11"]', interest=("brand",), user_groups=("all",))
TYPE = Rule.of('[type~"PROMO|LARGE"]', interest=("size",), sources=("catalogue",), user_groups=("all",))
SIZE = Rule.of('[size][size!="1"]', user_groups=("small",))
NODE_RULES = Rules((BRAND, TYPE, SIZE))
GRAPH_RULES = Rules((BRAND, Rule.of('[priority="1-URGENT"]'), Rule.of("[segment=BUILDING]")))
BOX = (-90.0, -60.0, 90.0, 60.0)
NOW = "2024-01-20 00:00:00"


def query(statement: str | None = None):
    """Register a function of a Warehouse under its name, with its statement."""

    def add(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Warehouse(spark, folder))
        if statement:
            ORACLE_SQL[f.__name__] = statement
        return f

    return add


def queue_of(w: Warehouse) -> DataFrame:
    return ingest.prune_unknown_deletes(w.changes, w.base)


def steps_of(w: Warehouse, name: str) -> Steps:
    return Steps(w.spark, name)


# --- base and import


@query(sql("SELECT objtype, count(*) AS objects, count(DISTINCT id) AS ids FROM base_keys GROUP BY objtype"))
def osm_base_counts(w: Warehouse) -> DataFrame:
    return w.base.groupBy("objtype").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("id").alias("ids"))


@query(sql("""
SELECT 'n' AS objtype, id, brand AS first_tag, lon, lat, NULL::BIGINT AS refs FROM base_n
UNION ALL SELECT 'w', id, priority, NULL, NULL, (SELECT count(*) FROM base_wn x WHERE x.id = base_w.id) FROM base_w
UNION ALL SELECT 'r', id, segment, NULL, NULL, (SELECT count(*) FROM base_rm x WHERE x.id = base_r.id) FROM base_r
"""))
def base_view(w: Warehouse) -> DataFrame:
    tag = F.coalesce(F.col("tags")["brand"], F.col("tags")["priority"], F.col("tags")["segment"])
    refs = F.coalesce(F.when(F.col("nodes").isNotNull(), F.size("nodes")), F.when(F.col("members").isNotNull(), F.size("members"))).cast("long")
    return w.base.select("objtype", "id", tag.alias("first_tag"), "lon", "lat", refs.alias("refs"))


@query(sql("""
SELECT id, max(version) AS version, count(*) AS extracts FROM (
  SELECT id, version FROM base_n WHERE id % 3 <> 0 UNION SELECT id, version FROM base_n WHERE id % 3 <> 1 UNION SELECT id, 2 FROM base_n WHERE id % 5 = 0) GROUP BY id
"""))
def extract_merge(w: Warehouse) -> DataFrame:
    n = w.nodes
    merged = ingest.merge_extracts(n.filter("id % 3 <> 0"), n.filter("id % 3 <> 1"), n.filter("id % 5 = 0").withColumn("version", F.lit(2)))
    return merged.groupBy("id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("extracts"))


@query(sql("SELECT id, version, deleted, ts AS created, lon, lat, event_type FROM cn"))
def import_last_write(w: Warehouse) -> DataFrame:
    empty = w.node_changes.limit(0).withColumns({"targeted": F.lit(False), "locha_id": F.lit(None).cast("long"), "cc_id": F.lit(None).cast("long")})
    queue = ingest.import_changes(empty, w.node_events)
    return queue.select("id", "version", "deleted", F.col("created").cast("timestamp_ntz").alias("created"), "lon", "lat", F.col("tags")["event_type"].alias("event_type"))


@query(sql("SELECT id, version, n AS insert_order FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, n DESC) AS r FROM ev) WHERE r = 1"))
def simplify_diffs(w: Warehouse) -> DataFrame:
    return ingest.simplify(w.node_events, F.col("insert_order")).select("id", "version", "insert_order")


@query(sql("SELECT count(DISTINCT seq) <= 1 AS consistent, count(DISTINCT seq) AS sequences FROM (SELECT o_orderkey % 3 AS seq FROM orders)"))
def sequence_consistency(w: Warehouse) -> DataFrame:
    return ingest.same_sequence(w.read("orders").select((F.col("o_orderkey") % 3).alias("sequence_number")))


@query(sql("SELECT objtype, id, version, deleted FROM queue"))
def prune_unknown_deletes(w: Warehouse) -> DataFrame:
    return queue_of(w).select("objtype", "id", "version", "deleted")


# --- filters


@query(sql("SELECT id FROM base_n WHERE brand = 'Brand#11' OR regexp_matches(type, 'PROMO|LARGE') OR size <> '1'"))
def tag_filter(w: Warehouse) -> DataFrame:
    return w.nodes.filter(NODE_RULES.predicate(F.col("tags"))).select("id")


@query(sql("SELECT id, type FROM base_n WHERE regexp_matches(type, 'PROMO|LARGE') AND NOT regexp_matches(brand, '#1')"))
def tag_filter_regex(w: Warehouse) -> DataFrame:
    rules = Rules((Rule.of('[type~"PROMO|LARGE"][brand!~"#1"]'),))
    return w.nodes.filter(rules.predicate(F.col("tags"))).select("id", F.col("tags")["type"].alias("type"))


TAG_CHANGED = """(((b.brand = 'Brand#11' OR coalesce(c.brand = 'Brand#11', FALSE)) AND b.brand IS DISTINCT FROM c.brand)
  OR (regexp_matches(b.type, 'PROMO|LARGE') AND (b.size IS NOT NULL OR b.type IS NOT NULL)) OR (b.size <> '1' AND b.size IS NOT NULL))"""


@query(sql(f"SELECT c.id FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id JOIN base_n b ON b.id = c.id WHERE {TAG_CHANGED}"))
def tag_diff_filter(w: Warehouse) -> DataFrame:
    pairs = queue_of(w).filter("objtype = 'n'").join(w.nodes.select("id", F.col("tags").alias("b_tags")), "id")
    return pairs.filter(NODE_RULES.changed(F.col("b_tags"), F.col("tags"))).select("id")


@query(sql("""
SELECT id, array_to_string(list_filter([CASE WHEN brand = 'Brand#11' THEN '[brand="Brand#11"]' END, CASE WHEN regexp_matches(type, 'PROMO|LARGE') THEN '[type~"PROMO|LARGE"]' END,
  CASE WHEN size <> '1' THEN '[size][size!=1]' END], lambda x: x IS NOT NULL), ' ') AS matches FROM base_n
"""))
def tag_matches(w: Warehouse) -> DataFrame:
    return w.nodes.select("id", F.array_join(NODE_RULES.matches(F.col("tags")), " ").alias("matches"))


@query(sql("""
SELECT id, array_to_string(list_sort(list_distinct(flatten([CASE WHEN brand = 'Brand#11' THEN ['brand'] ELSE [] END,
  CASE WHEN regexp_matches(type, 'PROMO|LARGE') THEN ['size', 'type'] ELSE [] END, CASE WHEN size <> '1' THEN ['size'] ELSE [] END]))), ',') AS keys FROM base_n
"""))
def interest_keys(w: Warehouse) -> DataFrame:
    return w.nodes.select("id", F.array_join(F.array_sort(NODE_RULES.keys_of_interest(F.col("tags"))), ",").alias("keys"))


@query(sql("SELECT id, lon, lat FROM cn WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -60 AND 60"))
def area_filter(w: Warehouse) -> DataFrame:
    rows = w.node_changes.withColumn("geom", G.point(F.col("lon"), F.col("lat")))
    return rows.filter(target.inside_box(*BOX)(F.col("geom"))).select("id", "lon", "lat")


def flagged_nodes(w: Warehouse) -> DataFrame:
    """Node changes with their flags; points alone, so that no vertex list is joined."""
    point = G.point(F.col("lon"), F.col("lat"))
    queue = queue_of(w).filter("objtype = 'n'")
    base = views.typed(w.nodes, "n")
    rows = target.enriched(queue, base, queue.select("objtype", "id", point.alias("geom")), base.select("objtype", "id", point.alias("geom")))
    return target.flags(rows, NODE_RULES, target.inside_box(*BOX))


@query(sql(f"""
SELECT id, new, CASE WHEN new THEN tc AND ac ELSE scope AND (changed OR moved) END AS targeted, CASE WHEN new THEN ac ELSE scope AND moved END AS geom_changed FROM (
  SELECT c.id, b.id IS NULL AS new, coalesce(c.brand = 'Brand#11', FALSE) AS tc, c.lon BETWEEN -90 AND 90 AND c.lat BETWEEN -60 AND 60 AS ac,
    (coalesce(b.brand = 'Brand#11' OR regexp_matches(b.type, 'PROMO|LARGE') OR b.size <> '1', FALSE) OR coalesce(c.brand = 'Brand#11', FALSE))
      AND (coalesce(b.lon BETWEEN -90 AND 90 AND b.lat BETWEEN -60 AND 60, TRUE) OR (c.lon BETWEEN -90 AND 90 AND c.lat BETWEEN -60 AND 60)) AS scope,
    coalesce({TAG_CHANGED}, FALSE) AS changed, b.lon IS DISTINCT FROM c.lon OR b.lat IS DISTINCT FROM c.lat AS moved
  FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id LEFT JOIN base_n b ON b.id = c.id)
"""))
def targeted_flags(w: Warehouse) -> DataFrame:
    return flagged_nodes(w).select("id", "new", "targeted", "geom_changed")


# --- graph


def graph_input(w: Warehouse) -> DataFrame:
    """Pending changes as the graph stages take them: references of before and after together, interest by tags, movement by place or references."""
    old = w.base.select("objtype", "id", F.lit(True).alias("known"), F.col("tags").alias("b_tags"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"), F.col("nodes").alias("b_nodes"), F.col("members").alias("b_members"))
    rows = queue_of(w).join(old, ["objtype", "id"], "left")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    moved = F.col("known").isNull() | F.col("deleted") | ~F.col("lon").eqNullSafe(F.col("b_lon")) | ~F.col("lat").eqNullSafe(F.col("b_lat")) | (size("nodes") != size("b_nodes")) | (size("members") != size("b_members"))
    both = lambda b, c: F.when(F.col(b).isNotNull() & F.col(c).isNotNull(), F.concat(b, c)).otherwise(F.coalesce(c, b))
    return rows.select(
        "objtype", "id", "version", "deleted", F.col("known").isNull().alias("new"), (GRAPH_RULES.predicate(F.col("b_tags")) | GRAPH_RULES.predicate(F.col("tags"))).alias("targeted"),
        moved.alias("geom_changed"), both("b_nodes", "nodes").alias("nodes"), both("b_members", "members").alias("members"),
    )


def active(w: Warehouse, steps: Steps) -> DataFrame:
    return steps.keep(target.activity(graph_input(w)))


@query(sql("SELECT objtype, id FROM newrefs"))
def propagate_new(w: Warehouse) -> DataFrame:
    return graph.new_references(graph_input(w))


@query(sql("SELECT objtype, id FROM gi WHERE objtype = 'n' AND (new OR id % 7 = 0) AND id IN (SELECT node FROM gn) UNION SELECT objtype, id FROM gi WHERE objtype = 'w' AND (new OR id % 7 = 0) AND id IN (SELECT ref FROM gm)"))
def propagate_new_members(w: Warehouse) -> DataFrame:
    """propagate_new where every seventh object counts as new, since the changes of the test tables refer to no new one."""
    return graph.new_references(graph_input(w).withColumn("new", F.col("new") | (F.col("id") % 7 == 0)))


@query(sql("SELECT id, propa FROM p1 WHERE objtype = 'w'"))
def propagate_ways(w: Warehouse) -> DataFrame:
    rows = graph_input(w).withColumn("propa", F.col("deleted"))
    return graph.forward_to_ways(rows).filter("objtype = 'w'").select("id", "propa")


@query(sql("SELECT objtype, id, propa, active, eligible FROM st"))
def propagate_relations(w: Warehouse) -> DataFrame:
    return target.activity(graph_input(w)).select("objtype", "id", "propa", "active", "eligible")


@query(sql("SELECT a, b FROM edges"))
def edges(w: Warehouse) -> DataFrame:
    return graph.edges(active(w, steps_of(w, "edges"))).distinct()


@query(sql("SELECT id, ref FROM gm WHERE ref IN (SELECT id FROM cw)"))
def member_edges(w: Warehouse) -> DataFrame:
    return graph.members_of(graph_input(w)).filter("type = 'w'").select("id", "ref")


def named(w: Warehouse, steps: Steps) -> DataFrame:
    rows = active(w, steps)
    return rows.join(graph.change_components(rows, steps), ["objtype", "id"])


@query(sql("SELECT objtype, id, cc_id FROM comp"))
def components(w: Warehouse) -> DataFrame:
    return named(w, steps_of(w, "components")).select("objtype", "id", "cc_id")


@query(sql("SELECT objtype, id, cc_id FROM comp"))
def components_updated(w: Warehouse) -> DataFrame:
    """The same from labels that are kept: first of links of which some are missing and some are to go, then of all that there are."""
    steps = steps_of(w, "updated")
    rows = steps.keep(active(w, steps))
    kept, links = graph.KeptComponents(w.spark, f"{steps.root}/kept"), steps.keep(graph.edges(rows))
    others = links.join(links.groupBy("b").agg(F.max("a").alias("a")), ["a", "b"], "left_anti").select("a", "b")
    kept.update(others.union(links.select(F.col("a"), (F.col("b") + 4).alias("b"))), steps)
    return graph.change_components(rows, steps, kept)


@query(sql("SELECT cc_id, count(*) AS objects FROM comp GROUP BY cc_id ORDER BY objects DESC, cc_id LIMIT 10"))
def component_histogram(w: Warehouse) -> DataFrame:
    return graph.histogram(named(w, steps_of(w, "histogram")))


@query(sql("SELECT c.objtype, c.id, q.version, q.deleted FROM comp c JOIN queue q ON c.objtype = q.objtype AND c.id = q.id WHERE cc_id NOT IN (SELECT cc_id FROM comp WHERE targeted)"))
def release_set(w: Warehouse) -> DataFrame:
    rows = named(w, steps_of(w, "release"))
    return target.release(rows, rows.filter("targeted").select("cc_id").distinct())


@query(sql("""
SELECT e.id AS way, n.id AS node FROM gn e JOIN comp x ON x.objtype = 'w' AND x.id = e.id JOIN comp n ON n.objtype = 'n' AND n.id = e.node
JOIN st a ON a.v = x.v JOIN st b ON b.v = n.v WHERE a.eligible AND b.eligible AND (a.active OR b.active) AND x.cc_id <> n.cc_id
"""))
def component_invariants(w: Warehouse) -> DataFrame:
    steps = steps_of(w, "invariants")
    rows = active(w, steps)
    return graph.broken_invariants(rows, graph.change_components(rows, steps))


# --- geometry


@query(sql("SELECT x.id, x.pos, x.node, n.lon, n.lat FROM base_wn x LEFT JOIN base_n n ON n.id = x.node"))
def way_vertices(w: Warehouse) -> DataFrame:
    return shapes.way_vertices(w.ways, w.nodes).select("id", F.col("pos").cast("long").alias("pos"), "node", "lon", "lat")


def box_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("b", G.bbox(F.col("geom"))).select("id", "b.min_x", "b.min_y", "b.max_x", "b.max_y")


@query(sql("SELECT x.id, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM base_wn x JOIN base_n n ON n.id = x.node GROUP BY x.id"))
def way_bbox(w: Warehouse) -> DataFrame:
    return box_columns(shapes.way_shapes(w.ways, w.nodes))


@query(sql("""
SELECT r.id, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y
FROM base_r r LEFT JOIN base_rm m ON m.id = r.id LEFT JOIN base_wn x ON x.id = m.ref LEFT JOIN base_n n ON n.id = x.node GROUP BY r.id
"""))
def relation_bbox(w: Warehouse) -> DataFrame:
    points = w.nodes.select("id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    return box_columns(shapes.relation_shapes(w.relations, points, shapes.way_shapes(w.ways, w.nodes)))


@query(sql("""
SELECT id, lon, lat FROM (SELECT coalesce(b.id, c.id) AS id, coalesce(c.lon, b.lon) AS lon, coalesce(c.lat, b.lat) AS lat
  FROM base_n b FULL JOIN (SELECT c.* FROM cn c JOIN queue q ON q.objtype = 'n' AND q.id = c.id) c ON b.id = c.id)
"""))
def overlay_nodes(w: Warehouse) -> DataFrame:
    return shapes.overlay_nodes(w.nodes, queue_of(w))


@query(sql("""
SELECT x.id, x.pos, x.node, coalesce(c.lon, n.lon) AS lon, coalesce(c.lat, n.lat) AS lat FROM cwn x
LEFT JOIN base_n n ON n.id = x.node LEFT JOIN (SELECT c.* FROM cn c JOIN queue q ON q.objtype = 'n' AND q.id = c.id) c ON c.id = x.node
"""))
def overlay_vertices(w: Warehouse) -> DataFrame:
    over = shapes.overlay_nodes(w.nodes, queue_of(w))
    return shapes.way_vertices(w.way_changes.filter("NOT deleted"), over).select("id", F.col("pos").cast("long").alias("pos"), "node", "lon", "lat")


@query(sql("""
SELECT id, count(*) FILTER (first OR lon <> px OR lat <> py) AS points, round(coalesce(sum(sqrt((lon - px) * (lon - px) + (lat - py) * (lat - py))), 0), 3) AS length FROM (
  SELECT x.id, lon, lat, lag(lon) OVER w AS px, lag(lat) OVER w AS py, row_number() OVER w = 1 AS first
  FROM base_wn x JOIN base_n n ON n.id = x.node WINDOW w AS (PARTITION BY x.id ORDER BY x.pos)) GROUP BY id
"""))
def way_lines(w: Warehouse) -> DataFrame:
    rows = shapes.way_shapes(w.ways, w.nodes).withColumn("part", F.get("geom.parts", F.lit(0)))
    return rows.select("id", F.size("part").cast("long").alias("points"), F.round(G.length(F.col("part")), 3).alias("length"))


@query(sql("""
SELECT id, round(coalesce(sum(sqrt((lon - px) * (lon - px) + (lat - py) * (lat - py))), 0), 3) AS length FROM (
  SELECT x.id, lon, lat, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM base_wn x JOIN base_n n ON n.id = x.node WINDOW w AS (PARTITION BY x.id ORDER BY x.pos)) GROUP BY id
"""))
def grid_lengths(w: Warehouse) -> DataFrame:
    """Lengths of ways, added up over their pieces in the cells of a grid."""
    pieces = shapes.way_shapes(w.ways, w.nodes).select("id", F.explode_outer(polygons.split_by_grid(F.col("geom"), 25.0)).alias("p"))
    each = F.aggregate(F.col("p.geom.parts"), F.lit(0.0), lambda s, part: s + G.length(part))
    return pieces.groupBy("id").agg(F.round(F.coalesce(F.sum(each), F.lit(0.0)), 3).alias("length"))


@query(sql("""
, hit AS (SELECT id FROM queue WHERE objtype = 'n'),
dw AS (SELECT DISTINCT id FROM base_wn WHERE node IN (SELECT id FROM hit) UNION SELECT id FROM cw)
SELECT 'w' AS objtype, id FROM dw UNION SELECT 'r', id FROM base_rm WHERE ref IN (SELECT id FROM dw) UNION SELECT 'r', id FROM cr
"""))
def dirty_set(w: Warehouse) -> DataFrame:
    q = queue_of(w)
    ids = lambda t: q.filter(F.col("objtype") == t).select("id")
    return shapes.dirty(w.ways, w.relations, ids("n"), ids("w"), ids("r"))


# --- integrity and apply


@query(sql("SELECT id AS way, node FROM base_wn WHERE node NOT IN (SELECT id FROM base_n WHERE id % 50 <> 7)"))
def fk_missing_nodes(w: Warehouse) -> DataFrame:
    return apply.missing_nodes(w.ways, w.nodes.filter("id % 50 <> 7"))


@query(sql("SELECT id AS node FROM queue WHERE objtype = 'n' AND deleted AND id IN (SELECT node FROM base_wn)"))
def fk_still_referenced(w: Warehouse) -> DataFrame:
    return apply.still_referenced(queue_of(w).filter("objtype = 'n' AND deleted"), w.ways)


@query(sql("SELECT id AS relation, 'w' AS type, ref FROM base_rm WHERE ref NOT IN (SELECT id FROM base_w)"))
def fk_missing_members(w: Warehouse) -> DataFrame:
    return apply.missing_members(w.relations, w.base)


ACCEPTED = "(SELECT * FROM queue WHERE id % 3 = 0)"


def accepted_of(queue: DataFrame) -> DataFrame:
    return queue.filter("id % 3 = 0").select("objtype", "id", "version", "deleted")


def accepted_keys(w: Warehouse) -> DataFrame:
    return accepted_of(queue_of(w))


@query(sql(f"""
SELECT objtype, id, version FROM base_keys b WHERE NOT EXISTS (SELECT 1 FROM {ACCEPTED} a WHERE a.objtype = b.objtype AND a.id = b.id AND NOT a.deleted)
UNION ALL SELECT objtype, id, version FROM {ACCEPTED} WHERE NOT deleted
"""))
def apply_upsert(w: Warehouse) -> DataFrame:
    return apply.upserted(w.base, apply.accepted_changes(queue_of(w), accepted_keys(w))).select("objtype", "id", "version")


@query(sql(f"SELECT objtype, id, version FROM base_keys b WHERE NOT EXISTS (SELECT 1 FROM {ACCEPTED} a WHERE a.objtype = b.objtype AND a.id = b.id AND a.deleted)"))
def apply_delete(w: Warehouse) -> DataFrame:
    return apply.without_deleted(w.base, apply.accepted_changes(queue_of(w), accepted_keys(w))).select("objtype", "id", "version")


def updated_base(w: Warehouse, compacted: bool, geometry: bool = False) -> tuple[dict[str, KeyedTable], Geometries]:
    """The base in keyed tables, with its geometry or without, after the accepted changes in two updates."""
    steps = steps_of(w, "keyed")
    kinds = {"nodes": (w.nodes, schemas.NODE, "n"), "ways": (w.ways, schemas.WAY, "w"), "relations": (w.relations, schemas.RELATION, "r")}
    base = {name: KeyedTable(w.spark, f"{steps.root}/{name}", schema) for name, (_, schema, _) in kinds.items()}
    for name, (rows, _, _) in kinds.items():
        base[name].replace(rows)
    kept = Geometries.under(base, steps.root)
    if geometry:
        kept.build()
    queue = steps.keep(queue_of(w.over(*[t.read() for t in base.values()], steps)))
    accepted = steps.keep(apply.accepted_changes(queue, accepted_of(queue).hint("merge")))
    for part in (accepted.filter("id % 2 = 0"), accepted.filter("id % 2 <> 0")):
        moved = steps.keep(kept.moved(part)) if geometry else None
        for name, (_, _, t) in kinds.items():
            base[name].change(part.filter(F.col("objtype") == t).withColumn("gone", F.col("deleted")))
        if geometry:
            kept.refresh(moved, steps)
    if compacted:
        for table in base.values():
            table.compact()
    return base, kept


APPLIED = f"""
SELECT objtype, id, version FROM base_keys b WHERE NOT EXISTS (SELECT 1 FROM {ACCEPTED} a WHERE a.objtype = b.objtype AND a.id = b.id)
UNION ALL SELECT objtype, id, version FROM {ACCEPTED} WHERE NOT deleted
"""


@query(sql(APPLIED))
def merge_on_read(w: Warehouse) -> DataFrame:
    base, _ = updated_base(w, compacted=False)
    return views.base_view(*[t.read() for t in base.values()]).select("objtype", "id", "version")


@query(sql(APPLIED))
def merge_compacted(w: Warehouse) -> DataFrame:
    base, _ = updated_base(w, compacted=True)
    return views.base_view(*[t.read() for t in base.values()]).select("objtype", "id", "version")


@query(sql(f"""
, acc AS {ACCEPTED},
an AS (SELECT id, lon, lat FROM base_n WHERE id NOT IN (SELECT id FROM acc WHERE objtype = 'n')
  UNION ALL SELECT c.id, c.lon, c.lat FROM cn c JOIN acc a ON a.objtype = 'n' AND a.id = c.id AND NOT a.deleted),
aw AS (SELECT id FROM base_w WHERE id NOT IN (SELECT id FROM acc WHERE objtype = 'w' AND deleted)),
awn AS (SELECT id, node FROM base_wn WHERE id NOT IN (SELECT id FROM acc WHERE objtype = 'w') UNION ALL SELECT id, node FROM cwn WHERE id IN (SELECT id FROM acc WHERE objtype = 'w')),
arm AS (SELECT id, ref FROM base_rm WHERE id NOT IN (SELECT id FROM acc WHERE objtype = 'r') UNION ALL SELECT id, ref FROM crm WHERE id IN (SELECT id FROM acc WHERE objtype = 'r'))
SELECT 'w' AS objtype, aw.id, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM aw LEFT JOIN awn x ON x.id = aw.id LEFT JOIN an ON an.id = x.node GROUP BY aw.id
UNION ALL SELECT 'r', r.id, min(lon), min(lat), max(lon), max(lat) FROM base_r r LEFT JOIN arm m ON m.id = r.id LEFT JOIN aw ON aw.id = m.ref LEFT JOIN awn x ON x.id = aw.id LEFT JOIN an ON an.id = x.node GROUP BY r.id
"""))
def geometry_refreshed(w: Warehouse) -> DataFrame:
    """Boxes of the geometry that is kept up to date by what each update touches."""
    _, kept = updated_base(w, compacted=False, geometry=True)
    boxes = lambda df, t: box_columns(df).select(F.lit(t).alias("objtype"), "id", "min_x", "min_y", "max_x", "max_y")
    return boxes(kept.lines.read(), "w").unionByName(boxes(kept.areas.read(), "r"))


@query(sql(f"SELECT objtype, id, version, deleted FROM {ACCEPTED}"))
def journal(w: Warehouse) -> DataFrame:
    queue = queue_of(w)
    before = queue.filter("id % 9 = 0")
    return apply.journaled(before, apply.accepted_changes(queue, accepted_keys(w))).select("objtype", "id", "version", "deleted")


@query(sql("SELECT objtype, id, version, deleted FROM queue WHERE id % 3 <> 0"))
def queue_after(w: Warehouse) -> DataFrame:
    queue = queue_of(w)
    return apply.left_in_queue(queue, apply.accepted_changes(queue, accepted_keys(w))).select("objtype", "id", "version", "deleted")


ACTIONS = "(SELECT *, CASE WHEN deleted THEN 'delete' WHEN version = 1 THEN 'create' ELSE 'modify' END AS action FROM (SELECT objtype, id, CASE WHEN id >= 1000000000 THEN 1 ELSE version END AS version, deleted FROM queue))"


def diff_rows(w: Warehouse) -> DataFrame:
    return queue_of(w).withColumn("version", F.when(F.col("id") >= 1_000_000_000, 1).otherwise(F.col("version")))


@query(sql(f"SELECT objtype, id, version, action FROM {ACTIONS}"))
def export_actions(w: Warehouse) -> DataFrame:
    return export.classified(diff_rows(w)).select("objtype", "id", "version", "action")


@query(sql(f"""
SELECT objtype, id, version, action, CAST(sum(CASE WHEN prev IS NOT DISTINCT FROM action THEN 0 ELSE 1 END) OVER (ORDER BY objtype, id, version) AS BIGINT) AS block
FROM (SELECT *, lag(action) OVER (ORDER BY objtype, id, version) AS prev FROM {ACTIONS})
"""))
def export_blocks(w: Warehouse) -> DataFrame:
    return export.blocks(diff_rows(w)).select("objtype", "id", "version", "action", "block")


@query("SELECT event_id AS sequence, substr(lpad(CAST(event_id * 7919 AS VARCHAR), 9, '0'), 1, 3) || '/' || substr(lpad(CAST(event_id * 7919 AS VARCHAR), 9, '0'), 4, 3) || '/' || substr(lpad(CAST(event_id * 7919 AS VARCHAR), 9, '0'), 7, 3) || '.osc.gz' AS path FROM events")
def sequence_path(w: Warehouse) -> DataFrame:
    return w.read("events").select(F.col("event_id").alias("sequence"), scalars.sequence_path(F.col("event_id") * 7919).alias("path"))


@query(sql("""
SELECT objtype, id, version, 'expected' AS side FROM base_keys WHERE id % 500 = 3 UNION ALL
SELECT objtype, id, version, 'found' AS side FROM base_keys WHERE id % 700 = 5
"""))
def integrity_diff(w: Warehouse) -> DataFrame:
    keys = w.base.select("objtype", "id", "version")
    twice = keys.unionByName(keys.filter("id % 500 = 3"))
    return apply.difference(twice, keys.unionByName(keys.filter("id % 700 = 5")))


@query(sql("SELECT objtype, id, version, 'expected' AS side FROM base_keys WHERE FALSE"))
def integrity_same(w: Warehouse) -> DataFrame:
    """Upstream with all changes equals the base with some applied and the rest applied after them."""
    steps = steps_of(w, "integrity")
    w = w.kept(steps)
    queue, base = steps.keep(queue_of(w)), w.base
    empty = queue.limit(0)
    everything, _, _ = apply.apply_changes(base, queue, empty, queue, steps)
    part, left, _ = apply.apply_changes(base, queue, empty, queue.filter("id % 3 = 0"), steps)
    left = steps.keep(left)
    rest, _, _ = apply.apply_changes(part, left, empty, left, steps)
    return apply.difference(everything.select("objtype", "id", "version"), rest.select("objtype", "id", "version"))


SETS_KNOWN = "(SELECT id, id % 11 = 0 AS open, created_at, updated_at FROM sets WHERE id % 4 <> 0)"


@query(sql(f"""
SELECT DISTINCT c.changeset_id AS id FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id LEFT JOIN {SETS_KNOWN} s ON s.id = c.changeset_id
WHERE s.id IS NULL OR s.open OR epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', s.updated_at))
  >= 21600.0 * pow(2.0, floor(log2(greatest(0.0, (epoch(date_trunc('second', s.updated_at)) - epoch(date_trunc('second', s.created_at))) / 21600.0) + 1)))
"""))
def missing_changesets(w: Warehouse) -> DataFrame:
    known = w.changesets.filter("id % 4 <> 0").withColumn("open", F.col("id") % 11 == 0)
    nodes = queue_of(w).filter("objtype = 'n'")
    return changesets.missing(w.base, nodes, known, F.lit(NOW).cast("timestamp_ntz"))


# --- rules and verdicts


def node_links(w: Warehouse) -> DataFrame:
    """A link for each pending node change that the base knows or that is new, with a logical change for each 100 ids."""
    state = lambda tags, deleted, user, created, sets, groups: F.struct(
        F.lit("n").alias("objtype"), F.col("id"), F.lit(1).alias("version"), deleted.alias("deleted"), created.alias("created"), user.alias("username"), tags.alias("tags"), sets.alias("changeset"), groups.alias("group_ids"), F.col("id").alias("cc_id")
    )
    sets = w.changesets.select(F.col("id").cast("int").alias("changeset_id"), F.struct("comments_count", F.col("tags").alias("tags")).alias("changeset"))
    queue = queue_of(w).filter("objtype = 'n'").join(sets, "changeset_id", "left")
    old = w.nodes.select("id", F.col("tags").alias("b_tags"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    rows = queue.join(old, "id", "left")
    no = F.lit(None)
    groups = F.array(F.when(F.col("lon") > 0, F.lit("all")).otherwise(F.lit("small")))
    none = no.cast("struct<comments_count:int,tags:map<string,string>>")
    before = F.when(F.col("b_tags").isNotNull(), state(F.col("b_tags"), F.lit(False), no.cast("string"), no.cast("timestamp_ntz"), none, groups))
    after = state(F.col("tags"), F.col("deleted"), F.col("username"), F.col("created"), F.col("changeset"), groups)
    dist = F.abs(F.col("lon") - F.col("b_lon")) + F.abs(F.col("lat") - F.col("b_lat"))
    return rows.select(
        F.floor(F.col("id") / 100).alias("locha_id"), F.floor(F.pmod("id", F.lit(100)) / 10).alias("cluster"), F.col("id").alias("link"),
        before.alias("before"), after.alias("after"), F.struct(F.lit("same").alias("conflate"), F.lit(1.0).alias("score"), dist.alias("max_distance")).alias("reason"),
    )


#: Keys that differ, by link: a missing value stands for the key's name.
DIFF = """
, pair AS (SELECT c.id, c.id // 100 AS locha_id, (c.id % 100) // 10 AS cluster, c.deleted, c.event_type AS a_event, c.brand AS a_brand, b.brand AS b_brand, b.type AS b_type, b.size AS b_size, b.id IS NOT NULL AS known,
    c.user_id, c.ts, c.changeset_id, c.lon, abs(c.lon - b.lon) + abs(c.lat - b.lat) AS dist FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id LEFT JOIN base_n b ON b.id = c.id),
tagkeys AS (
  SELECT id, 'event_type' AS key FROM pair WHERE coalesce(a_event, 'event_type') <> 'event_type'
  UNION ALL SELECT id, 'brand' FROM pair WHERE coalesce(b_brand, 'brand') <> coalesce(a_brand, 'brand')
  UNION ALL SELECT id, 'type' FROM pair WHERE coalesce(b_type, 'type') <> 'type'
  UNION ALL SELECT id, 'size' FROM pair WHERE coalesce(b_size, 'size') <> 'size'),
attkeys AS (SELECT id, 'deleted' AS key FROM pair WHERE NOT known OR deleted),
keys AS (SELECT id, 'tag' AS kind, key FROM tagkeys UNION ALL SELECT id, 'attrib', key FROM attkeys)"""


def diffed(final: str, *more: str) -> str:
    return sql(final, DIFF.strip().removeprefix(","), *more)


@query(diffed("SELECT id AS link, key FROM tagkeys"))
def tag_diff(w: Warehouse) -> DataFrame:
    return validate.diff_rows(node_links(w)).filter("kind = 'tag'").select("link", "key")


@query(diffed("SELECT id AS link, key FROM attkeys"))
def attr_diff(w: Warehouse) -> DataFrame:
    return validate.diff_rows(node_links(w)).filter("kind = 'attrib'").select("link", "key")


def said(rows: DataFrame) -> DataFrame:
    """(link, kind, key, said): the actions on each key, in order."""
    text = lambda v: F.array_join(F.transform(v, lambda a: F.concat_ws(":", a["validator_id"], a["action"])), ",")
    one = lambda kind, c: rows.select("link", F.lit(kind).alias("kind"), F.explode(c).alias("key", "v")).select("link", "kind", "key", text(F.col("v")).alias("said"))
    return one("attrib", "attribs").unionByName(one("tag", "tags"))


def chain(w: Warehouse, *validators: validate.Validator) -> DataFrame:
    rows = validate.diff(node_links(w))
    for v in validators:
        rows = v.apply(rows)
    return rows


@query(diffed("SELECT k.id AS link, kind, key, CASE WHEN p.user_id IN (3, 7, 20) THEN 'user_list:accept' ELSE '' END AS said FROM keys k JOIN pair p ON p.id = k.id"))
def val_user_list(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.UserList("user_list", "accept", users=("user3", "user7", "user20"))))


@query(diffed("SELECT k.id AS link, kind, key, CASE WHEN p.deleted THEN 'deleted:reject' ELSE '' END AS said FROM keys k JOIN pair p ON p.id = k.id"))
def val_deleted(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.Deleted("deleted")))


AGE = "epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', p.ts))"


@query(diffed(f"""
SELECT k.id AS link, kind, key, CASE WHEN {AGE} <= 400000 AND {AGE} >= 300000 THEN 'delayed:reject,delayed:accept' WHEN {AGE} <= 400000 THEN 'delayed:reject' WHEN {AGE} >= 300000 THEN 'delayed:accept' ELSE '' END AS said
FROM keys k JOIN pair p ON p.id = k.id
"""))
def val_delayed(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.Delayed("delayed", "reject", before_delay=400_000, after_delay=300_000, now=NOW, after_verdict="accept")))


CHANGESET_KEY = """SELECT id AS link, kind, key, '' AS said FROM keys UNION ALL
SELECT p.id, 'attrib', 'changeset', '{name}:reject' FROM pair p JOIN sets s ON s.id = p.changeset_id WHERE {when}"""


@query(diffed(CHANGESET_KEY.format(name="changeset_comment", when="s.comments_count > 0")))
def val_changeset_comment(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.ChangesetComment("changeset_comment")))


@query(diffed(CHANGESET_KEY.format(name="changeset_review_requested", when="s.review_requested = 'yes'")))
def val_review_requested(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.ChangesetReviewRequested("changeset_review_requested")))


INTEREST = """CASE WHEN kind = 'attrib' THEN '' WHEN key = 'brand' AND (coalesce(p.b_brand = 'Brand#11', FALSE) OR coalesce(p.a_brand = 'Brand#11', FALSE)) THEN 'tags_changes:reject'
  WHEN key IN ('size', 'type') AND regexp_matches(coalesce(p.b_type, ''), 'PROMO|LARGE') THEN 'tags_changes:reject'
  WHEN key = 'size' AND coalesce(p.b_size <> '1', FALSE) THEN 'tags_changes:reject' ELSE 'tags_changes:accept' END"""


@query(diffed(f"""SELECT k.id AS link, kind, key, {INTEREST} AS said,
  CASE WHEN kind = 'tag' AND key IN ('size', 'type') AND regexp_matches(coalesce(p.b_type, ''), 'PROMO|LARGE') THEN 'catalogue' ELSE '' END AS sources FROM keys k JOIN pair p ON p.id = k.id"""))
def val_tags_changes(w: Warehouse) -> DataFrame:
    """The actions on each key, and the sources of the rules it is of interest to."""
    rows = chain(w, validate.TagsChanges("tags_changes", rules=NODE_RULES))
    sources = lambda v: F.array_join(F.filter(F.transform(v, lambda a: a["options"]["sources"]), lambda x: x.isNotNull()), ",")
    one = lambda kind, c: rows.select("link", F.lit(kind).alias("kind"), F.explode(c).alias("key", "v")).select("link", "kind", "key", sources(F.col("v")).alias("sources"))
    return said(rows).join(one("attrib", "attribs").unionByName(one("tag", "tags")), ["link", "kind", "key"])


@query(diffed("""SELECT id AS link, kind, key, '' AS said FROM keys UNION ALL
SELECT id, 'attrib', 'geom', CASE WHEN dist < 3 THEN 'geom_changes:accept' ELSE 'geom_changes:reject' END FROM pair WHERE coalesce(dist, 0) <> 0"""))
def val_geom_changes(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.GeomChanges("geom_changes", dist=3.0)))


@query(diffed("SELECT id AS link, kind, key, 'all:accept' AS said FROM keys"))
def val_action_force(w: Warehouse) -> DataFrame:
    return said(chain(w, validate.Deleted("deleted"), validate.All("all", "accept", force=True)))


#: Verdicts after tags_changes and then deleted=accept: by key, link, cluster and logical change.
VERDICT = f"""verdict AS (
  SELECT p.id, p.locha_id, p.cluster, CASE WHEN bool_or(coalesce(s LIKE '%reject%', FALSE)) THEN 'reject' WHEN bool_and(k.id IS NULL OR (s <> '' AND s NOT LIKE '%reject%')) THEN 'accept' END AS action
  FROM pair p LEFT JOIN (SELECT k.id, kind, key, {INTEREST} || CASE WHEN p.deleted THEN ',deleted:accept' ELSE '' END AS s FROM keys k JOIN pair p ON p.id = k.id) k ON k.id = p.id GROUP BY ALL),
cluster_verdict AS (SELECT locha_id, cluster, CASE WHEN bool_or(coalesce(action = 'reject', FALSE)) THEN 'reject' WHEN bool_and(action IS NOT NULL) THEN 'accept' END AS action FROM verdict GROUP BY ALL),
locha_verdict AS (SELECT locha_id, CASE WHEN bool_or(coalesce(action = 'reject', FALSE)) THEN 'reject' WHEN bool_and(action IS NOT NULL) THEN 'accept' END AS action FROM cluster_verdict GROUP BY ALL)"""


def judged(w: Warehouse) -> DataFrame:
    return validate.spread(validate.link_verdict(chain(w, validate.TagsChanges("tags_changes", rules=NODE_RULES), validate.Deleted("deleted", "accept"))))


@query(diffed("SELECT id AS link, action FROM verdict", VERDICT))
def link_verdict(w: Warehouse) -> DataFrame:
    return validate.link_verdict(chain(w, validate.TagsChanges("tags_changes", rules=NODE_RULES), validate.Deleted("deleted", "accept"))).select("link", "action")


@query(diffed("SELECT v.id AS link, CASE WHEN c.action = 'reject' THEN 'reject' ELSE v.action END AS action, c.action AS cluster_action FROM verdict v JOIN cluster_verdict c USING (locha_id, cluster)", VERDICT))
def cluster_propagation(w: Warehouse) -> DataFrame:
    return judged(w).select("link", "action", "cluster_action")


@query(diffed("SELECT locha_id, action AS locha_action FROM locha_verdict", VERDICT))
def locha_verdict(w: Warehouse) -> DataFrame:
    return judged(w).select("locha_id", "locha_action").distinct()


GATE = """candidates AS (SELECT id, CASE WHEN lon > 0 THEN coalesce(b_brand = 'Brand#11', FALSE) OR coalesce(a_brand = 'Brand#11', FALSE) OR regexp_matches(coalesce(b_type, ''), 'PROMO|LARGE')
  ELSE coalesce(b_size <> '1', FALSE) END AS candidate FROM pair)"""


@query(diffed("SELECT id AS link, candidate FROM candidates", GATE))
def candidate_gate(w: Warehouse) -> DataFrame:
    return validate.gated(node_links(w), NODE_RULES).select("link", "candidate")


@query(diffed("SELECT DISTINCT locha_id, cluster, ((locha_id * 9999991 + cluster + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS semantic_group FROM pair"))
def semantic_group_id(w: Warehouse) -> DataFrame:
    return node_links(w).select("locha_id", "cluster", scalars.wrap_int32(F.col("locha_id") * 9999991 + F.col("cluster")).alias("semantic_group")).distinct()


# --- duplicates and network


def planar(w: Warehouse) -> tuple[DataFrame, DataFrame, Rules]:
    rules = Rules((Rule.of('[brand="Brand#11"]', duplicate_distance=6.0), Rule.of("[brand~\"#(5|12|20)$\"]", duplicate_distance=4.0)))
    base = w.nodes.select(F.lit("n").alias("objtype"), "id", "tags", F.col("lon").alias("x"), F.col("lat").alias("y"))
    # Whether a node's change is in the queue hangs on nodes alone; written once, as the rules look at it several times.
    rows = steps_of(w, "planar").keep(ingest.prune_unknown_deletes(w.node_changes, views.typed(w.nodes, "n")).select("objtype", "id", "deleted", "tags", "lon", "lat"))
    return base, rows.select("objtype", "id", F.pmod("id", F.lit(10)).alias("locha_id"), "deleted", "tags", F.col("lon").alias("x"), F.col("lat").alias("y")), rules


PLANAR = """
kind AS (SELECT id, lon AS x, lat AS y, CASE WHEN brand = 'Brand#11' THEN 0 WHEN regexp_matches(brand, '#(5|12|20)$') THEN 1 END AS index FROM base_n),
bn AS (SELECT *, CASE index WHEN 0 THEN 6.0 ELSE 4.0 END AS distance FROM kind WHERE index IS NOT NULL),
chg AS (SELECT * FROM (SELECT c.id, c.id % 10 AS locha_id, c.lon AS x, c.lat AS y, c.deleted, CASE WHEN c.brand = 'Brand#11' THEN 0 WHEN regexp_matches(c.brand, '#(5|12|20)$') THEN 1 END AS index
  FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id) WHERE index IS NOT NULL),
ch AS (SELECT *, CASE index WHEN 0 THEN 6.0 ELSE 4.0 END AS distance FROM chg),
cand AS (SELECT b.id, b.index, b.distance, b.x, b.y, min(c.locha_id) AS locha_id FROM bn b JOIN ch c ON c.index = b.index AND (c.x - b.x) ** 2 + (c.y - b.y) ** 2 <= c.distance ** 2 GROUP BY ALL),
bcount AS (SELECT a.index, a.id, count(*) AS count FROM cand a LEFT JOIN cand b ON a.index = b.index AND a.locha_id = b.locha_id AND a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= a.distance ** 2 GROUP BY ALL),
alive AS (SELECT id, index, distance, x, y, locha_id FROM ch WHERE NOT deleted),
pool AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.id = cand.id AND ch.locha_id = cand.locha_id AND ch.index = cand.index) UNION ALL BY NAME SELECT * FROM alive),
ctwins AS (SELECT a.locha_id, a.index, a.id, count(*) AS count, string_agg('n' || b.id, ',' ORDER BY b.id) AS duplicates FROM alive a JOIN pool b ON a.locha_id = b.locha_id AND a.index = b.index AND a.id <> b.id
  AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= a.distance ** 2 GROUP BY ALL)"""


@query(sql("SELECT index, id, count FROM bcount", PLANAR))
def duplicates_base_count(w: Warehouse) -> DataFrame:
    base, changes, rules = planar(w)
    candidates = duplicates.base_candidates(duplicates.matching(base, rules), duplicates.matching(changes, rules))
    return duplicates.base_counts(candidates).select("index", "id", "count")


@query(sql("SELECT locha_id, index, id, count, duplicates FROM ctwins", PLANAR))
def duplicates_changes(w: Warehouse) -> DataFrame:
    base, changes, rules = planar(w)
    found = duplicates.matching(changes, rules)
    candidates = duplicates.base_candidates(duplicates.matching(base, rules), found)
    rows = duplicates.change_twins(candidates, found, found.filter("NOT deleted"))
    return rows.select("locha_id", "index", "id", "count", F.array_join("duplicates", ",").alias("duplicates"))


@query(sql("SELECT c.locha_id, c.index, c.id, CASE WHEN b.id IS NULL THEN c.duplicates ELSE 'n' || c.id END AS duplicates FROM ctwins c LEFT JOIN bcount b ON b.index = c.index AND b.id = c.id WHERE b.id IS NULL OR c.count > b.count", PLANAR))
def duplicates_diff(w: Warehouse) -> DataFrame:
    rows = duplicates.duplicates(*planar(w))
    return rows.select("locha_id", "index", "id", F.array_join("duplicates", ",").alias("duplicates"))


def network_input(w: Warehouse) -> tuple[DataFrame, DataFrame, DataFrame, Rules]:
    rows = queue_of(w).withColumns({"locha_id": F.floor(F.col("id") / 2000), "targeted": F.col("id") % 400 == 0})
    return w.ways, w.nodes, rows, Rules((Rule.of("[status!=P]"),))


NETWORK = """
sel AS (SELECT id, id // 2000 AS locha_id, id % 400 = 0 AS targeted, deleted FROM cw WHERE status <> 'P'),
bpool AS (SELECT DISTINCT x.id, x.node FROM base_wn x JOIN base_w w ON w.id = x.id WHERE w.status <> 'P'),
bnb AS (SELECT s.locha_id, s.id, a.node, b.id AS way_id FROM sel s JOIN bpool a ON a.id = s.id AND s.targeted JOIN bpool b ON b.node = a.node AND b.id <> s.id
  WHERE NOT EXISTS (SELECT 1 FROM sel o WHERE o.locha_id = s.locha_id AND o.id = b.id)),
own AS (SELECT DISTINCT id, node FROM cwn),
lpool AS (SELECT id, node FROM bpool WHERE id NOT IN (SELECT id FROM cw) UNION SELECT o.id, o.node FROM own o JOIN cw ON cw.id = o.id WHERE cw.status <> 'P'),
cnb AS (SELECT s.locha_id, s.id, a.node, b.id AS way_id FROM sel s JOIN own a ON a.id = s.id AND s.targeted AND NOT s.deleted JOIN lpool b ON b.node = a.node AND b.id <> s.id
  WHERE NOT EXISTS (SELECT 1 FROM sel o WHERE o.locha_id = s.locha_id AND o.id = b.id AND NOT o.deleted))"""


def exploded(df: DataFrame, column: str) -> DataFrame:
    return df.select("locha_id", "id", F.explode(column).alias("n")).select("locha_id", "id", F.col("n.id").alias("node"), "n.way_id")


@query(sql("SELECT locha_id, id, node, way_id FROM bnb", NETWORK))
def network_base_neighbors(w: Warehouse) -> DataFrame:
    ways, nodes, changes, rules = network_input(w)
    return exploded(network.base_neighbors(ways, nodes, changes, rules), "neighbors")


@query(sql("SELECT locha_id, id, node, way_id FROM cnb", NETWORK))
def network_change_neighbors(w: Warehouse) -> DataFrame:
    ways, nodes, changes, rules = network_input(w)
    return exploded(network.change_neighbors(ways, nodes, changes, rules), "neighbors")


@query(sql("""
SELECT locha_id, id, count(DISTINCT b) AS base_neighbors, count(DISTINCT c) AS change_neighbors FROM (
  SELECT locha_id, bnb.id, (node, way_id, x.lon, x.lat) AS b, NULL AS c FROM bnb JOIN base_n x ON x.id = node UNION ALL
  SELECT locha_id, cnb.id, NULL, (node, way_id, coalesce(n.lon, x.lon), coalesce(n.lat, x.lat)) FROM cnb JOIN base_n x ON x.id = node
    LEFT JOIN (SELECT c.* FROM cn c JOIN queue q ON q.objtype = 'n' AND q.id = c.id) n ON n.id = node)
GROUP BY ALL HAVING list_sort(list(DISTINCT b) FILTER (b IS NOT NULL)) IS DISTINCT FROM list_sort(list(DISTINCT c) FILTER (c IS NOT NULL))
""", NETWORK))
def network_diff(w: Warehouse) -> DataFrame:
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c)
    return network.network_diff(*network_input(w)).select("locha_id", "id", size("base_neighbors"), size("change_neighbors"))


# --- logical changes


@query(sql("SELECT id, round(lon / 25.0) * 25.0 + 0.0 AS x, round(lat / 25.0) * 25.0 + 0.0 AS y FROM cn"))
def snap_grid(w: Warehouse) -> DataFrame:
    return w.node_changes.select("id", (G.snapped(F.col("lon"), 25.0) + 0.0).alias("x"), (G.snapped(F.col("lat"), 25.0) + 0.0).alias("y"))


@query(sql("SELECT id // 100 AS locha_id, string_agg(objtype || '|' || id || '|' || version || '|' || deleted, ',' ORDER BY objtype, id) AS signature FROM queue GROUP BY 1"))
def locha_signature(w: Warehouse) -> DataFrame:
    return locha.signatures(queue_of(w).withColumn("locha_id", F.floor(F.col("id") / 100)), "locha_id")


@query(sql("SELECT objtype, id, dense_rank() OVER (ORDER BY id // 100, version) AS number FROM queue"))
def locha_renumber(w: Warehouse) -> DataFrame:
    rows = queue_of(w).withColumn("part", F.floor(F.col("id") / 100))
    return locha.renumbered(rows, "part", "version").select("objtype", "id", F.col("number").cast("long").alias("number"))


def placed_nodes(w: Warehouse) -> DataFrame:
    cell = F.struct(F.round(F.col("lon") / 60).cast("long").alias("x"), F.round(F.col("lat") / 60).cast("long").alias("y"))
    return queue_of(w).filter("objtype = 'n' AND NOT deleted").select("id", cell.alias("cell"), G.point(F.col("lon"), F.col("lat")).alias("geom"))


PLACE_CLUSTERS = """
, pts AS (SELECT c.id, round(c.lon / 60) AS gx, round(c.lat / 60) AS gy, c.lon, c.lat FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id WHERE NOT c.deleted),
eps AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.gx = b.gx AND a.gy = b.gy AND (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2 <= 36),
linked AS (SELECT id, id AS r FROM pts UNION SELECT l.id, e.b FROM linked l JOIN eps e ON e.a = l.r)
SELECT id, min(r) AS cluster FROM linked GROUP BY id
"""


@query(sql(PLACE_CLUSTERS))
def dbscan(w: Warehouse) -> DataFrame:
    """Clusters by place of all pending nodes, created ones too."""
    return locha.linked_clusters(placed_nodes(w), 6.0, steps_of(w, "dbscan"))


@query(sql(PLACE_CLUSTERS))
def dbscan_queue(w: Warehouse) -> DataFrame:
    """The same under the name that it had while dbscan left created nodes out."""
    return dbscan(w)


@query()
def kmeans_split(w: Warehouse) -> DataFrame:
    """Clusters of at most 99 parts; k-means has no statement."""
    p = w.nodes.select("id", F.floor(F.col("id") / 700).alias("cluster"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return locha.split_large(p, 10.0)


@query()
def locha_assign(w: Warehouse) -> DataFrame:
    """Logical changes of the pending node changes: by place within 5 and by topology."""
    steps = steps_of(w, "locha")
    rows = steps.keep(flagged_nodes(w))
    return locha.assign_locha(rows.join(graph.change_components(target.activity(rows), steps), ["objtype", "id"]), 5.0, steps)


@query(sql("""
, shape AS (SELECT v AS id, lon, lat FROM st JOIN cn c ON st.objtype = 'n' AND c.id = st.id UNION SELECT v, b.lon, b.lat FROM st JOIN base_n b ON st.objtype = 'n' AND b.id = st.id),
flat AS (SELECT DISTINCT s.id, s.lon, s.lat, round(c.lon / 40) AS gx, round(c.lat / 40) AS gy FROM shape s JOIN cn c ON c.id = s.id // 4),
hops AS (SELECT DISTINCT a.id AS a, b.id AS b FROM flat a JOIN flat b ON a.lon = b.lon AND a.lat = b.lat AND a.gx = b.gx AND a.gy = b.gy),
linked AS (SELECT id, id AS r FROM flat UNION SELECT l.id, h.b FROM linked l JOIN hops h ON h.a = l.r),
whole AS (SELECT id, min(r) AS first FROM linked GROUP BY id),
places AS (SELECT w.id, w.first AS cluster, c.lon AS x, c.lat AS y FROM whole w JOIN cn c ON c.id = w.id // 4)
""" + "".join(f",\n{table}" for table in split_sql.split("places", most=99, radius=8.0)) + """
SELECT 'n' AS objtype, id // 4 AS id, min(id) OVER (PARTITION BY cluster, part) // 4 AS first FROM parted
"""))
def locha_assign_same_place(w: Warehouse) -> DataFrame:
    """Logical changes of the pending node changes at a distance below the grid of places, so that they meet in the same place only; named by their least node.

    Clusters are split as the operator does it: parts of at most 99 changes where their places allow it, none wider than 20 distances.
    """
    steps = steps_of(w, "same_place")
    rows = steps.keep(flagged_nodes(w))
    found = locha.assign_locha(rows.join(graph.change_components(target.activity(rows), steps), ["objtype", "id"]), 0.4, steps)
    return found.select("objtype", "id", F.min("id").over(Window.partitionBy("locha_id")).alias("first"))


@query()
def released_with_geometry(w: Warehouse) -> DataFrame:
    """The whole targeting stage, with the geometry of ways and relations."""
    steps = steps_of(w, "whole")
    w = w.kept(steps)
    queue = steps.keep(queue_of(w))
    base_geom = steps.keep(shapes.base_shapes(w.nodes, w.ways, w.relations, queue))
    change_geom = steps.keep(shapes.change_shapes(w.nodes, w.ways, w.relations, queue))
    _, out = target.release_untargeted(w.base, queue.withColumns({"targeted": F.lit(False), "cc_id": F.lit(None).cast("long")}), base_geom, change_geom, GRAPH_RULES, steps, target.inside_box(*BOX), 1.0)
    return out


@query()
def line_merge(w: Warehouse) -> DataFrame:
    """Stitched member lines of relations: how many lines and vertices."""
    points = w.nodes.select("id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    rows = shapes.relation_shapes(w.relations, points, shapes.way_shapes(w.ways, w.nodes))
    return rows.select("id", F.col("geom.kind").alias("kind"), F.size("geom.parts").alias("lines"), F.size(G.vertices(F.col("geom"))).alias("vertices"))


# --- review


def log_of(w: Warehouse) -> DataFrame:
    return validate.log_rows(judged(w).withColumn("matches", F.array().cast("array<string>")), F.lit(NOW).cast("timestamp_ntz"))


PENDING = "pend AS (SELECT v.id, locha_id, cluster, CASE WHEN c.action = 'reject' THEN 'reject' ELSE v.action END AS action FROM verdict v JOIN cluster_verdict c USING (locha_id, cluster))"


@query(diffed("SELECT count(DISTINCT (locha_id, cluster)) AS pending FROM pend WHERE action IS NULL OR action = 'reject'", VERDICT, PENDING))
def pending_count(w: Warehouse) -> DataFrame:
    return review.pending_count(log_of(w))


@query(diffed("SELECT id, locha_id, dense_rank() OVER (PARTITION BY locha_id ORDER BY cluster) - 1 AS link_index FROM pend", VERDICT, PENDING))
def review_index(w: Warehouse) -> DataFrame:
    return review.link_index(log_of(w)).select(F.col("after_object.id").alias("id"), "locha_id", F.col("link_index").cast("long").alias("link_index"))


@query(diffed("SELECT locha_id, cluster + locha_id AS semantic_group, count(*) AS links FROM pend WHERE action IS NULL OR action = 'reject' GROUP BY ALL", VERDICT, PENDING))
def review_links(w: Warehouse) -> DataFrame:
    rows = review.link_lists(log_of(w)).select("locha_id", F.explode("links").alias("g", "l"))
    return rows.select("locha_id", F.col("g").cast("long").alias("semantic_group"), F.size("l").cast("long").alias("links"))


@query(diffed("SELECT locha_id FROM pend GROUP BY locha_id HAVING bool_and(coalesce(action = 'accept', FALSE))", VERDICT, PENDING))
def wholly_accepted(w: Warehouse) -> DataFrame:
    return review.wholly_accepted(log_of(w))


@query(diffed("SELECT 'n' AS objtype, p.id, 1 AS version, p.deleted FROM pend JOIN pair p ON p.id = pend.id WHERE pend.locha_id IN (SELECT locha_id FROM pend GROUP BY locha_id HAVING bool_and(coalesce(action = 'accept', FALSE)))", VERDICT, PENDING))
def accepted_objects(w: Warehouse) -> DataFrame:
    log = log_of(w)
    return review.keys_of(log, review.wholly_accepted(log))


#: Users whose changes are accepted whole, where each object is a logical change of its own.
TRUSTED = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


def trusted_log(w: Warehouse) -> DataFrame:
    rows = validate.diff(node_links(w).withColumns({"locha_id": F.col("link"), "cluster": F.lit(0).cast("long")}))
    rows = validate.UserList("user_list", "accept", users=tuple(f"user{u}" for u in TRUSTED)).apply(rows)
    rows = validate.spread(validate.link_verdict(rows)).withColumn("matches", F.array().cast("array<string>"))
    return validate.log_rows(rows, F.lit(NOW).cast("timestamp_ntz"))


@query(diffed(f"SELECT id AS locha_id FROM pair p WHERE user_id IN {TRUSTED} OR NOT EXISTS (SELECT 1 FROM keys k WHERE k.id = p.id)"))
def wholly_accepted_of_users(w: Warehouse) -> DataFrame:
    return review.wholly_accepted(trusted_log(w))


@query(diffed(f"SELECT 'n' AS objtype, id, 1 AS version, deleted FROM pair p WHERE user_id IN {TRUSTED} OR NOT EXISTS (SELECT 1 FROM keys k WHERE k.id = p.id)"))
def accepted_objects_of_users(w: Warehouse) -> DataFrame:
    log = trusted_log(w)
    return review.keys_of(log, review.wholly_accepted(log))


@query(diffed("SELECT id, CASE WHEN locha_id = 0 THEN 'accept' ELSE action END AS action, CASE WHEN locha_id = 0 THEN 42 END AS validator_uid FROM pend", VERDICT, PENDING))
def accept_by_hand(w: Warehouse) -> DataFrame:
    chosen = w.spark.createDataFrame([(0,)], "locha_id long")
    return review.accepted_by_hand(log_of(w), chosen, 42).select(F.col("after_object.id").alias("id"), "action", "validator_uid")


@query(diffed("SELECT count(*) AS objects, count(*) FILTER (action = 'accept') AS accepted FROM pend WHERE action = 'accept' OR id % 2 = 0", VERDICT, PENDING))
def log_refresh(w: Warehouse) -> DataFrame:
    log = log_of(w)
    out = review.refreshed(log, log.filter("(action IS NULL OR action = 'reject') AND after_object.id % 2 = 0"))
    return out.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("action") == "accept").alias("accepted"))


@query(diffed("""
SELECT locha_id, max(ts) AS created, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS features, count(DISTINCT cluster) AS links FROM (
  SELECT w.locha_id, w.cluster, c.ts, c.lon AS x, c.lat AS y FROM waits w JOIN cn c ON c.id = w.id
  UNION ALL SELECT w.locha_id, w.cluster, NULL, b.lon, b.lat FROM waits w JOIN base_n b ON b.id = w.id) GROUP BY locha_id
""", VERDICT, PENDING, "waits AS (SELECT * FROM pend WHERE action IS NULL OR action = 'reject')"))
def review_features(w: Warehouse) -> DataFrame:
    """Feature collections of the logical changes that wait."""
    point = G.point(F.col("lon"), F.col("lat")).alias("geom")
    queue = queue_of(w).filter("objtype = 'n'").withColumn("version", F.lit(1))
    base = views.typed(w.nodes, "n")
    log = log_of(w)
    rows = review.features(log, base, queue, base.select("objtype", "id", point), queue.select("objtype", "id", point))
    return review.collections(log, rows).select("locha_id", "created", "min_x", "min_y", "max_x", "max_y", F.size("features").cast("long").alias("features"), F.size("links").cast("long").alias("links"))


# --- version history


@query(sql("""
SELECT q.id, b.version AS before_version, q.version AS after_version, s.comments_count FROM queue q JOIN cn c ON q.objtype = 'n' AND q.id = c.id
LEFT JOIN base_n b ON b.id = q.id LEFT JOIN sets s ON s.id = c.changeset_id
"""))
def version_history(w: Warehouse) -> DataFrame:
    point = G.point(F.col("lon"), F.col("lat")).alias("geom")
    queue = queue_of(w).filter("objtype = 'n'").withColumns({"locha_id": F.col("id"), "cc_id": F.col("id")})
    base = views.typed(w.nodes, "n")
    rows = history.versions(base, queue, base.select("objtype", "id", point), queue.select("objtype", "id", point), w.changesets, {})
    pairs = history.sides(history.history(rows))
    return pairs.select("id", F.col("before.version").alias("before_version"), F.col("after.version").alias("after_version"), F.col("after.changeset.comments_count").cast("long").alias("comments_count"))


# --- queries over views


@query(sql("SELECT count(*) AS objects, sum(id) AS ids FROM base_n WHERE brand = 'Brand#11' AND lon BETWEEN -90 AND 90 AND lat BETWEEN -60 AND 60"))
def overpass_nodes(w: Warehouse) -> DataFrame:
    objects = views.typed(w.nodes, "n").withColumn("geom", G.point(F.col("lon"), F.col("lat")))
    found = overpass.query(objects, 'node[brand="Brand#11"](-60,-90,60,90);out ids;')
    return found.select(F.get_json_object("j", "$.id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("objects"), F.sum("id").alias("ids"))


@query(sql("SELECT DISTINCT id FROM base_wn WHERE node IN (SELECT id FROM base_n WHERE brand = 'Brand#11' AND type = 'PROMO')"))
def overpass_recurse(w: Warehouse) -> DataFrame:
    objects = w.base.withColumn("geom", F.when(F.col("objtype") == "n", G.point(F.col("lon"), F.col("lat"))))
    found = overpass.query(objects, 'node[brand="Brand#11"][type=PROMO];<;way._;out ids;')
    return found.select(F.get_json_object("j", "$.id").cast("long").alias("id"))


@query(sql("""
SELECT id + 3600000000 AS id FROM base_r UNION ALL
SELECT id FROM base_wn GROUP BY id HAVING count(*) >= 4 AND arg_min(node, pos) = arg_max(node, pos)
"""))
def overpass_areas_id(w: Warehouse) -> DataFrame:
    return views.entity_views(w.nodes, w.ways, w.relations)["area"].select("id")
