"""The rule engine: differences of links, validators that append actions to them, verdicts and their spread."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import scalars
from terravet.functions.tags import Rules

ACTION = "struct<validator_id:string,action:string,options:map<string,string>>"
ACTIONS = f"map<string,array<{ACTION}>>"


def action(validator_id: str, verdict: Column | str, options: Column | None = None) -> Column:
    verdict = F.lit(verdict) if isinstance(verdict, str) else verdict
    options = options if options is not None else F.lit(None).cast("map<string,string>")
    return F.struct(F.lit(validator_id).alias("validator_id"), verdict.alias("action"), options.alias("options")).cast(ACTION)


# --- differences


def tag_keys(before: Column, after: Column) -> Column:
    """Keys whose values differ, a missing value standing for the key's own name."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(before, none), F.coalesce(after, none)
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b))))
    return F.filter(keys, lambda k: F.coalesce(a[k], k) != F.coalesce(b[k], k))


def attrib_keys(before: Column, after: Column) -> Column:
    """`deleted` if it differs; a side that is missing differs from one that isn't deleted."""
    differs = ~before["deleted"].eqNullSafe(after["deleted"])
    return F.when(differs, F.array(F.lit("deleted"))).otherwise(F.array().cast("array<string>"))


def empty_actions(keys: Column) -> Column:
    nothing = F.array().cast(f"array<{ACTION}>")
    return F.map_from_arrays(keys, F.transform(keys, lambda k: nothing))


def diff(links: DataFrame) -> DataFrame:
    """links with attribs and tags: maps from what differs to no actions yet. A link that isn't a candidate has none."""
    none = F.create_map().cast(ACTIONS)
    a, t = empty_actions(attrib_keys(F.col("before"), F.col("after"))), empty_actions(tag_keys(F.col("before.tags"), F.col("after.tags")))
    candidate = F.col("candidate") if "candidate" in links.columns else F.lit(True)
    return links.withColumn("attribs", F.when(candidate, a).otherwise(none)).withColumn("tags", F.when(candidate, t).otherwise(none))


def diff_rows(links: DataFrame) -> DataFrame:
    """(locha_id, link, kind, key) of what differs."""
    rows = diff(links)
    one = lambda kind, c: rows.select("locha_id", "link", F.lit(kind).alias("kind"), F.explode(F.map_keys(c)).alias("key"))
    return one("attrib", "attribs").unionByName(one("tag", "tags"))


# --- actions on a difference


def appended(held: Column, new: Column, force: bool) -> Column:
    return F.array(new) if force else F.concat(held, F.array(new))


def on_every_key(actions: Column, when: Column, new: Column | Callable[[Column], Column], force: bool = False) -> Column:
    make = new if callable(new) and not isinstance(new, Column) else lambda k: new
    return F.when(F.coalesce(when, F.lit(False)), F.transform_values(actions, lambda k, v: appended(v, make(k), force))).otherwise(actions)


def on_key(actions: Column, key: str, when: Column, new: Column, force: bool = False) -> Column:
    """The action on one key, which is made if it isn't there."""
    has = F.map_contains_key(actions, F.lit(key))
    changed = F.transform_values(actions, lambda k, v: F.when(k == key, appended(v, new, force)).otherwise(v))
    made = F.map_concat(actions, F.create_map(F.lit(key), F.array(new)).cast(ACTIONS))
    return F.when(~F.coalesce(when, F.lit(False)), actions).when(has, changed).otherwise(made)


# --- validators


@dataclass(frozen=True)
class Validator:
    """A step of the chain: apply() takes links with attribs and tags and appends actions.

    verdict: what it says where it acts, reject unless set. force: it clears what was said on the key before.
    """

    id: str
    verdict: str = "reject"
    force: bool = False

    def apply(self, links: DataFrame) -> DataFrame:
        raise NotImplementedError

    def say(self, options: Column | None = None) -> Column:
        return action(self.id, self.verdict, options)

    def everywhere(self, links: DataFrame, when: Column) -> DataFrame:
        cols = {c: on_every_key(F.col(c), self.candidate(links) & when, self.say(), self.force) for c in ("attribs", "tags")}
        return links.withColumns(cols)

    def at(self, links: DataFrame, key: str, when: Column, options: Column | None = None) -> DataFrame:
        return links.withColumn("attribs", on_key(F.col("attribs"), key, self.candidate(links) & when, self.say(options), self.force))

    def candidate(self, links: DataFrame) -> Column:
        return F.col("candidate") if "candidate" in links.columns else F.lit(True)


class ChangesetComment(Validator):
    """The changeset has comments."""

    def apply(self, links: DataFrame) -> DataFrame:
        return self.at(links, "changeset", F.col("after.changeset.comments_count") > 0)


class ChangesetReviewRequested(Validator):
    """The changeset asks for a review."""

    def apply(self, links: DataFrame) -> DataFrame:
        return self.at(links, "changeset", F.col("after.changeset.tags")["review_requested"] == "yes")


@dataclass(frozen=True)
class Delayed(Validator):
    """The change is younger than before_delay, or older than after_delay (seconds)."""

    before_delay: int | None = None
    after_delay: int | None = None
    now: str = "1970-01-01T00:00:00"
    after_verdict: str | None = None

    def __post_init__(self):
        if self.before_delay is None and self.after_delay is None:
            raise ValueError("delayed: before_delay or after_delay has to be given")

    def apply(self, links: DataFrame) -> DataFrame:
        age = F.unix_timestamp(F.to_timestamp(F.lit(self.now))) - F.unix_timestamp(F.col("after.created").cast("timestamp"))
        if self.before_delay is not None:
            links = self.everywhere(links, age <= self.before_delay)
        if self.after_delay is not None:
            links = replace(self, verdict=self.after_verdict or self.verdict).everywhere(links, age >= self.after_delay)
        return links


class Deleted(Validator):
    """The object is gone."""

    def apply(self, links: DataFrame) -> DataFrame:
        return self.everywhere(links, F.col("after").isNull() | F.col("after.deleted"))


@dataclass(frozen=True)
class Dual(Validator):
    """Says accept under one name and reject under another; both are its own unless configured."""

    accept: str | None = None
    reject: str | None = None

    def yes(self, options: Column | None = None) -> Column:
        return action(self.accept or self.id, "accept", options)

    def no(self, options: Column | None = None) -> Column:
        return action(self.reject or self.id, "reject", options)


@dataclass(frozen=True)
class GeomChanges(Dual):
    """The geometry moved: less than dist is accepted, more rejected; not at all says nothing. dist is in the links' plane."""

    dist: float = 0.0

    def apply(self, links: DataFrame) -> DataFrame:
        d = F.col("reason.max_distance")
        moved = F.coalesce(d, F.lit(0.0)) != 0
        options = F.create_map(F.lit("dist"), d.cast("string"))
        said = F.when(d < self.dist, self.yes(options)).otherwise(self.no(options))
        return links.withColumn("attribs", on_key(F.col("attribs"), "geom", self.candidate(links) & moved, said, self.force))


class GeomInvalid(Validator):
    """The new geometry can't be built, or isn't valid while the old one was."""

    def apply(self, links: DataFrame) -> DataFrame:
        alive = F.col("after").isNotNull() & ~F.col("after.deleted")
        before_bad = F.col("before").isNotNull() & ~F.col("before.deleted") & ~G.is_valid("before.geom")
        why = F.when(F.col("after.geom").isNull(), F.lit("missing")).otherwise(F.lit("invalid"))
        bad = alive & (F.col("after.geom").isNull() | (~G.is_valid("after.geom") & ~before_bad))
        return self.at(links, "geom", bad, F.create_map(F.lit("reason"), why))


class GeomNewObject(Validator):
    """Acts on `members` of a new object; as no difference has that key, on nothing."""

    def apply(self, links: DataFrame) -> DataFrame:
        new = self.candidate(links) & F.col("before").isNull()
        changed = F.transform_values("attribs", lambda k, v: F.when(k == "members", appended(v, self.say(), self.force)).otherwise(v))
        return links.withColumn("attribs", F.when(new, changed).otherwise(F.col("attribs")))


@dataclass(frozen=True)
class TagsChanges(Dual):
    """Differences in keys of interest are rejected with the sources of the rules they are of interest to, others accepted.

    A key is of interest to a rule that selects the tags before and finds it there, or the tags after.
    """

    rules: Rules = field(default_factory=Rules)

    def apply(self, links: DataFrame) -> DataFrame:
        found = [self.rules.interests(F.col(f"{side}.tags")) for side in ("before", "after")]
        rows = links.withColumn("__rules", F.concat(*found))

        def said(k: Column) -> Column:
            own = F.filter("__rules", lambda r: F.array_contains(r["keys"], k))
            sources = F.flatten(F.transform(own, lambda r: r["sources"]))
            options = F.when(F.size(sources) > 0, F.create_map(F.lit("sources"), F.array_join(sources, ",")))
            return F.when(F.size(own) > 0, self.no(options)).otherwise(self.yes())

        return rows.withColumn("tags", on_every_key(F.col("tags"), self.candidate(links), said, self.force)).drop("__rules")


@dataclass(frozen=True)
class UserList(Validator):
    """The author is one of these."""

    users: tuple[str, ...] = ()

    def apply(self, links: DataFrame) -> DataFrame:
        return self.everywhere(links, F.col("after.username").isin(list(self.users)) if self.users else F.lit(False))


@dataclass(frozen=True)
class All(Validator):
    """Says the same about everything, or with block=False nothing."""

    block: bool = True

    def apply(self, links: DataFrame) -> DataFrame:
        return self.everywhere(links, F.lit(self.block))


@dataclass(frozen=True)
class Duplicate(Validator):
    """Objects that stand where others of their kind do. found: (locha_id, objtype, id, duplicates array<string>)."""

    found: DataFrame | None = None

    def apply(self, links: DataFrame) -> DataFrame:
        hit = self.found.groupBy("locha_id", "objtype", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("duplicates")))).alias("__twins"))
        on = (links["locha_id"] == hit["locha_id"]) & (links["after"]["objtype"] == hit["objtype"]) & (links["after"]["id"] == hit["id"])
        rows = links.join(hit.select("locha_id", "objtype", "id", "__twins"), on, "left").select(*[links[c] for c in links.columns], "__twins")
        options = F.create_map(F.lit("node_id"), F.array_join("__twins", ","))
        return replace(self, found=None).at(rows, "geom", F.col("__twins").isNotNull(), options).drop("__twins")


@dataclass(frozen=True)
class Network(Validator):
    """Ways that lose or gain a connection. found: (locha_id, id, base_neighbors, change_neighbors), arrays of (id, way_id, x, y)."""

    found: DataFrame | None = None

    def apply(self, links: DataFrame) -> DataFrame:
        own = F.col("before.objtype").eqNullSafe("w") & F.col("after.objtype").eqNullSafe("w") & self.candidate(links)
        b = self.found.select(F.col("locha_id").alias("__l"), F.col("id").alias("__b"), F.col("base_neighbors").alias("__bn"))
        a = self.found.select(F.col("locha_id").alias("__m"), F.col("id").alias("__a"), F.col("change_neighbors").alias("__an"))
        rows = links.join(b, (F.col("locha_id") == F.col("__l")) & (F.col("before.id") == F.col("__b")) & own, "left")
        rows = rows.join(a, (F.col("locha_id") == F.col("__m")) & (F.col("after.id") == F.col("__a")) & own & ~F.col("after.deleted"), "left")
        w = Window.partitionBy("locha_id", "cluster")
        every = lambda c: F.array_distinct(F.flatten(F.collect_list(c).over(w)))
        rows = rows.withColumn("__all_b", every("__bn")).withColumn("__all_a", every("__an"))
        alike = lambda n, m: (n["id"] == m["id"]) | (n["way_id"] == m["way_id"]) | ((n["x"] == m["x"]) & (n["y"] == m["y"]))
        only = lambda mine, others: F.filter(F.array_distinct(F.coalesce(mine, F.array().cast(mine_type))), lambda n: ~F.exists(others, lambda m: alike(n, m)))
        mine_type = self.found.schema["base_neighbors"].dataType.simpleString()
        rows = rows.withColumn("__lost", only(F.col("__bn"), F.col("__all_a"))).withColumn("__gain", only(F.col("__an"), F.col("__all_b")))
        for name, column, key in (("lost_connection", "__lost", "disconnected_from_way_id"), ("gain_connection", "__gain", "connected_to_way_id")):
            options = F.create_map(F.lit(key), F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda n: n["way_id"].cast("string")))), ","))
            rows = rows.withColumn("attribs", on_key(F.col("attribs"), "geom", F.size(column) > 0, action(name, "reject", options)))
        return rows.select(*links.columns)


REGISTRY: dict[str, type[Validator]] = {
    "changeset_comment": ChangesetComment,
    "changeset_review_requested": ChangesetReviewRequested,
    "delayed": Delayed,
    "deleted": Deleted,
    "duplicate": Duplicate,
    "geom_changes": GeomChanges,
    "geom_invalid": GeomInvalid,
    "geom_new_object": GeomNewObject,
    "network": Network,
    "tags_changes": TagsChanges,
    "user_list": UserList,
    "all": All,
}


def register(name: str, kind: type[Validator]) -> None:
    """Make a validator known to configurations under a name."""
    REGISTRY[name] = kind


def kind_of(name: str, settings: dict) -> str:
    """The registered name of a configured validator: its `instance` in snake case, or its id."""
    named = settings.get("instance")
    return re.sub(r"(?<!^)(?=[A-Z])", "_", named.rpartition("::")[2].rpartition(".")[2]).lower() if named else name


def build(name: str, settings: dict, **given) -> Validator:
    """A validator from its configuration: `instance` names the kind if the id doesn't; action_force beside action clears."""
    kind = REGISTRY[kind_of(name, settings)]
    settings = {k: v for k, v in settings.items() if k != "instance"}
    names = {"list": "users", "block": "block"}
    fields = {names.get(k, k): v for k, v in settings.items()}
    if "action_force" in fields:
        fields |= {"verdict": fields.pop("action_force"), "force": True}
    if "action" in fields:
        fields["verdict"] = fields.pop("action")
    for key in ("description", "osm_tags"):
        fields.pop(key, None)
    if not issubclass(kind, Dual) and {"accept", "reject"} & fields.keys():
        raise ValueError(f"{name}: accept and reject name the two verdicts of other validators")
    if "users" in fields:
        fields["users"] = tuple(fields["users"])
    return kind(name, **fields, **given)


# --- gate, verdicts, spread


def gated(links: DataFrame, rules: Rules) -> DataFrame:
    """links with candidate and matches: a link is judged only if a rule that selects a side is of a group that the side is in."""
    side = lambda s: F.coalesce(F.arrays_overlap(rules.groups(F.col(f"{s}.tags")), F.col(f"{s}.group_ids")), F.lit(False))
    texts = F.array_union(F.coalesce(rules.matches(F.col("before.tags")), F.array().cast("array<string>")), F.coalesce(rules.matches(F.col("after.tags")), F.array().cast("array<string>")))
    return links.withColumn("candidate", side("before") | side("after")).withColumn("matches", texts)


def link_verdict(links: DataFrame) -> DataFrame:
    """links with action: accept if all that differs is accepted, reject if anything is rejected, else null."""
    lists = F.concat(F.map_values("attribs"), F.map_values("tags"))
    rejects = F.exists(lists, lambda v: F.exists(v, lambda a: a["action"] == "reject"))
    accepts = F.forall(lists, lambda v: (F.size(v) > 0) & F.forall(v, lambda a: a["action"] == "accept"))
    return links.withColumn("action", F.when(accepts, "accept").when(rejects, "reject"))


def worst(reject: Column, null: Column) -> Column:
    return F.when(reject, F.lit("reject")).when(~null, F.lit("accept"))


def spread(links: DataFrame) -> DataFrame:
    """links after link_verdict, with cluster_action and locha_action: reject goes before null before accept.

    A rejected candidate rejects every link of its cluster, with semantic_rejection_propagation on attribs.id.
    """
    candidate = F.col("candidate") if "candidate" in links.columns else F.lit(True)
    by_cluster, by_locha = Window.partitionBy("locha_id", "cluster"), Window.partitionBy("locha_id")
    rejected = F.max((candidate & F.coalesce(F.col("action") == "reject", F.lit(False))).cast("int")).over(by_cluster) == 1
    open_ = F.max((candidate & F.col("action").isNull()).cast("int")).over(by_cluster) == 1
    rows = links.withColumn("cluster_action", worst(rejected, open_))
    hit = F.col("cluster_action") == "reject"
    told = on_key(F.col("attribs"), "id", hit & ~F.coalesce(F.col("action") == "reject", F.lit(False)), action("semantic_rejection_propagation", "reject"))
    rows = rows.withColumn("attribs", told).withColumn("action", F.when(hit, "reject").otherwise(F.col("action")))
    some = lambda c: F.max(c.cast("int")).over(by_locha) == 1
    return rows.withColumn("locha_action", worst(some(F.coalesce(hit, F.lit(False))), some(F.col("cluster_action").isNull())))


def log_rows(links: DataFrame, created: Column) -> DataFrame:
    """Rows of the review log; semantic_group is the logical change's id and the cluster's number, wrapped to 32 bits."""
    key = lambda s: F.when(F.col(s).isNotNull(), F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("objtype", "id", "version", "deleted")]))
    return links.select(
        created.cast("timestamp_ntz").alias("created"),
        "locha_id",
        scalars.wrap_int32(F.col("locha_id") + F.col("cluster")).alias("semantic_group"),
        key("before").alias("before_object"),
        key("after").alias("after_object"),
        "matches",
        "action",
        F.lit(None).cast("int").alias("validator_uid"),
        F.col("attribs").alias("diff_attribs"),
        F.col("tags").alias("diff_tags"),
        F.to_json("reason").alias("conflation"),
    )


def validate(links: DataFrame, validators: list[Validator], rules: Rules | None = None) -> DataFrame:
    """The whole chain: gate, differences, validators in order, verdicts and their spread."""
    rows = gated(links, rules) if rules is not None else links
    rows = diff(rows)
    for v in validators:
        rows = v.apply(rows)
    return spread(link_verdict(rows))
