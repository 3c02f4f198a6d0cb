"""The review log: what waits, as features and feeds; accepting by hand."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import scalars
from terravet.operators import export


def pending(log: DataFrame) -> DataFrame:
    """Rows without a verdict or rejected."""
    return log.filter(F.col("action").isNull() | (F.col("action") == "reject"))


def pending_count(log: DataFrame) -> DataFrame:
    """One row: pairs of logical change and group that wait."""
    return pending(log).agg(F.count_distinct(F.struct("locha_id", "semantic_group")).alias("pending"))


def link_index(log: DataFrame) -> DataFrame:
    """log with link_index: the place of the group in its logical change, from 0."""
    return log.withColumn("link_index", F.dense_rank().over(Window.partitionBy("locha_id").orderBy("semantic_group")) - 1)


def link_lists(log: DataFrame) -> DataFrame:
    """(locha_id, links): the links of each group of each logical change that waits, by group."""
    before = F.when(F.col("before_object").isNotNull(), F.concat(F.lit("b"), "before_object.objtype", F.col("before_object.id").cast("string")))
    after = F.when(F.col("after_object").isNotNull(), F.concat(F.lit("a"), "after_object.objtype", F.col("after_object.id").cast("string")))
    link = F.struct(before.alias("before"), after.alias("after"), "action", "matches", "diff_attribs", "diff_tags", "conflation")
    rows = pending(log).select("locha_id", "semantic_group", F.struct(before.alias("b"), after.alias("a")).alias("o"), F.to_json(link).alias("link"))
    groups = rows.groupBy("locha_id", "semantic_group").agg(F.array_sort(F.collect_list(F.struct("o", "link"))).alias("l"))
    named = groups.select("locha_id", F.struct(F.col("semantic_group").cast("string").alias("key"), F.transform("l", lambda s: s["link"]).alias("value")).alias("e"))
    return named.groupBy("locha_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("links"))


def features(log: DataFrame, base: DataFrame, queue: DataFrame, base_geom: DataFrame, change_geom: DataFrame) -> DataFrame:
    """(locha_id, feature_id, created, geom, properties): each object version that a waiting link names, once.

    Ids are b for before or a for after, the type and the number; properties are JSON without nulls.
    """
    wait = pending(log)

    def side(name: str, letter: str, objects: DataFrame, shapes: DataFrame) -> DataFrame:
        keys = wait.filter(f"{name} IS NOT NULL").select("locha_id", f"{name}.objtype", f"{name}.id", f"{name}.version", f"{name}.deleted").distinct()
        rows = keys.join(objects.drop("deleted", "locha_id"), ["objtype", "id", "version"]).join(shapes, ["objtype", "id"], "left")
        props = F.to_json(F.struct("objtype", "id", "version", "deleted", "username", "created", "tags", "changeset_id"))
        return rows.select("locha_id", F.concat(F.lit(letter), "objtype", F.col("id").cast("string")).alias("feature_id"), "created", "geom", props.alias("properties"))

    return side("before_object", "b", base, base_geom).unionByName(side("after_object", "a", queue, change_geom)).dropDuplicates(["locha_id", "feature_id"])


def collections(log: DataFrame, feature_rows: DataFrame, changeset_rows: DataFrame | None = None) -> DataFrame:
    """(locha_id, created, min_x, min_y, max_x, max_y, features, links): a feature collection for each waiting logical change, oldest first."""
    box = G.bbox(F.col("geom"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), G.to_geojson(F.col("geom")).alias("geometry"), F.col("properties")))
    rows = feature_rows.withColumn("b", box).withColumn("feature", F.struct("feature_id", text.alias("json")))
    each = rows.groupBy("locha_id").agg(
        F.max("created").alias("created"),
        F.min("b.min_x").alias("min_x"),
        F.min("b.min_y").alias("min_y"),
        F.max("b.max_x").alias("max_x"),
        F.max("b.max_y").alias("max_y"),
        F.transform(F.array_sort(F.collect_list("feature")), lambda f: f["json"]).alias("features"),
    )
    out = each.join(link_lists(log), "locha_id")
    if changeset_rows is not None:
        out = out.join(changesets_of(log, changeset_rows), "locha_id", "left")
    return out.orderBy("created", "locha_id")


def changesets_of(log: DataFrame, version_sets: DataFrame) -> DataFrame:
    """(locha_id, changesets): the distinct changesets (locha_id, changeset struct with an id) of each waiting logical change."""
    wait = pending(log).select("locha_id").distinct()
    one = version_sets.join(wait, "locha_id", "left_semi").select("locha_id", F.col("changeset.id").alias("cid"), F.to_json("changeset").alias("json")).dropDuplicates(["locha_id", "cid"])
    return one.groupBy("locha_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cid", "json"))), lambda s: s["json"]).alias("changesets"))


def atom(rows: list[dict], title: str, link: str) -> str:
    """A feed of rows of collections, given as dictionaries."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<feed xmlns="http://www.w3.org/2005/Atom">', f"<title>{escape(title)}</title>", f"<id>{escape(link)}</id>"]
    for r in rows:
        where = ""
        if r["min_x"] is not None:
            where = f" at {(r['min_y'] + r['max_y']) / 2:.5f}, {(r['min_x'] + r['max_x']) / 2:.5f}"
        here = f"{link}#locha_{r['locha_id']}"
        out += ["<entry>", f"<id>{escape(here)}</id>", f"<title>{escape(str(r['locha_id']) + where)}</title>", f"<updated>{r['created'].strftime('%Y-%m-%dT%H:%M:%SZ') if r['created'] else ''}</updated>", f"<link href={quoteattr(here)}/>"]
        out += [f'<content type="text">{escape(f)}</content>' for f in r["features"][:1]] + ["</entry>"]
    return "\n".join([*out, "</feed>"])


def entries(found: DataFrame, link: str) -> DataFrame:
    """(text): the entries of a feed of collections, oldest first over the partitions; what `atom` writes for them."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    here = F.concat(F.lit(f"{link}#locha_"), F.col("locha_id").cast("string"))
    middle = lambda a, b: F.format_string("%.5f", (F.col(a) + F.col(b)) / 2)
    where = F.when(F.col("min_x").isNull(), F.lit("")).otherwise(F.concat(F.lit(" at "), middle("min_y", "max_y"), F.lit(", "), middle("min_x", "max_x")))
    quoted = F.replace(text(here), F.lit('"'), F.lit("&quot;"))
    first = F.when(F.size("features") > 0, F.concat(F.lit('\n<content type="text">'), text(F.get("features", F.lit(0))), F.lit("</content>"))).otherwise(F.lit(""))
    row = F.concat(
        F.lit("<entry>\n<id>"), text(here), F.lit("</id>\n<title>"), text(F.concat(F.col("locha_id").cast("string"), where)), F.lit("</title>\n<updated>"),
        F.coalesce(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")), F.lit('</updated>\n<link href="'), quoted, F.lit('"/>'), first, F.lit("\n</entry>"),
    )
    return found.repartitionByRange("created", "locha_id").sortWithinPartitions("created", "locha_id").select(row.alias("text"))


def write_atom(found: DataFrame, title: str, link: str, path: str) -> None:
    """A feed of all collections as a file, whose entries the executors write."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n<title>{escape(title)}</title>\n<id>{escape(link)}</id>\n'
    export.write_lines(entries(found, link), head, lambda: "</feed>\n", path, zipped=False)


def refreshed(log: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The log's accepted rows and, in place of all that waited, the new ones."""
    return log.filter("action = 'accept'").unionByName(new_rows.select(log.columns))


def wholly_accepted(new_rows: DataFrame) -> DataFrame:
    """(locha_id) of which every link is accepted."""
    open_ = new_rows.filter("action IS NULL OR action <> 'accept'").select("locha_id")
    return new_rows.select("locha_id").distinct().join(open_, "locha_id", "left_anti")


def keys_of(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """(objtype, id, version, deleted) after the links of chosen (locha_id, and semantic_group or not)."""
    on = [c for c in ("locha_id", "semantic_group") if c in chosen.columns]
    rows = log.join(chosen.select(on).distinct(), on, "left_semi").filter("after_object IS NOT NULL")
    return rows.select("after_object.objtype", "after_object.id", "after_object.version", "after_object.deleted").distinct()


def accepted_by_hand(log: DataFrame, chosen: DataFrame, uid: int) -> DataFrame:
    """The log with the links of chosen accepted by a user."""
    on = [c for c in ("locha_id", "semantic_group") if c in chosen.columns]
    rows = log.join(chosen.select(on).distinct().withColumn("__hit", F.lit(True)), on, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return rows.withColumns({"action": F.when(hit, "accept").otherwise(F.col("action")), "validator_uid": F.when(hit, F.lit(uid)).otherwise(F.col("validator_uid"))}).select(log.columns)


def project_listing(projects: DataFrame, url: str) -> DataFrame:
    """projects (id, title, polygon, pending, ...) with the polygon's path under a public address."""
    return projects.withColumn("polygon", F.regexp_replace("polygon", "^(\\./)?", url.rstrip("/") + "/"))


def centre_of(row: DataFrame) -> DataFrame:
    return row.withColumns({"lon": scalars.centre(F.col("min_x"), F.col("max_x")), "lat": scalars.centre(F.col("min_y"), F.col("max_y"))})


def feature_column(id_: Column, props: Column, geom: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), props.alias("properties"), G.to_geojson(geom).alias("geometry")))
