"""A project's tables and the stages of an update over them.

Each stage writes new versions of the tables it changes beside the old ones; a pointer names the current version, so that a
reader never sees half a stage and a lost one is run again from what it began with. The base and its geometry are large and
change little: they are keyed tables, to which an update adds its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravet import schemas
from terravet.functions import geometry as G
from terravet.functions import overpass
from terravet.operators import apply, changesets, duplicates, export, graph, history, ingest, locha, network, review, shapes, target, validate, views
from terravet.plans.geometries import Geometries, points
from terravet.plans.keyed import KeyedTable
from terravet.plans.tables import Steps, importable
from terravet.sources import osc, pbf, replication
from terravet.sources.config import Config

TABLES = {
    "nodes": schemas.NODE,
    "ways": schemas.WAY,
    "relations": schemas.RELATION,
    "queue": schemas.CHANGE,
    "journal": schemas.CHANGE,
    "changesets": schemas.CHANGESET,
    "log": schemas.LOG,
}
KINDS = {"n": "nodes", "w": "ways", "r": "relations"}


@dataclass
class Project:
    """Tables under one folder, and what the configuration says about them."""

    spark: SparkSession
    folder: str
    config: Config

    def __post_init__(self) -> None:
        importable(self.spark)
        self.open_steps: list[Steps] = []

    def steps(self, name: str) -> Steps:
        """Tables between stages; those that an update makes go with its end."""
        self.open_steps.append(Steps(self.spark, name))
        return self.open_steps[-1]

    def keyed(self, name: str) -> KeyedTable:
        """A table of the base."""
        return KeyedTable(self.spark, f"{self.folder}/{name}", TABLES[name])

    @property
    def geometries(self) -> Geometries:
        """The geometry of the base, as it is now."""
        return Geometries.under({name: self.keyed(name) for name in KINDS.values()}, self.folder)

    def table(self, name: str) -> DataFrame:
        if name in KINDS.values():
            return self.keyed(name).read()
        found = apply.current(self.spark, f"{self.folder}/{name}")
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def put(self, **tables: DataFrame) -> None:
        """Whole tables in place of what there was."""
        for name, df in tables.items():
            if name in KINDS.values():
                self.keyed(name).replace(df)
                continue
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
            apply.set_aside(df.select(cols), f"{self.folder}/{name}")

    @property
    def plane(self) -> G.Projection:
        """The configured projection to metres; one that isn't known by its number is a plane about the middle of the project's area."""
        points = [v for p in self.config.polygons or [] for ring in p for v in ring]
        middle = lambda i: (min(v[i] for v in points) + max(v[i] for v in points)) / 2 if points else 0.0
        return G.Projection(self.config.local_srid, (middle(0), middle(1)))

    @property
    def base(self) -> DataFrame:
        return views.base_view(self.table("nodes"), self.table("ways"), self.table("relations"))

    def put_base(self, base: DataFrame) -> None:
        base = self.steps("base").keep(base)
        self.put(**{name: base.filter(F.col("objtype") == t) for t, name in KINDS.items()})

    def shapes(self) -> tuple[DataFrame, DataFrame]:
        """Geometry of what the queue touches: its base objects, with the member ways of its relations, and its changes."""
        n, w, r, queue = self.table("nodes"), self.table("ways"), self.table("relations"), self.table("queue")
        ids = lambda t: queue.filter(F.col("objtype") == t).select("id")
        steps, kept = self.steps("shapes"), self.geometries.current()
        members = r.join(ids("r"), "id", "left_semi").select(F.explode("members").alias("m")).filter("m.type = 'w'").select(F.col("m.ref").alias("id"))
        some = lambda df, which, t: df.join(which, "id", "left_semi").select(F.lit(t).alias("objtype"), "id", "geom")
        base = some(points(n), ids("n"), "n").unionByName(some(kept.lines.read(), ids("w").union(members).distinct(), "w")).unionByName(some(kept.areas.read(), ids("r"), "r"))
        return steps.keep(base), steps.keep(shapes.change_shapes(n, w, r, queue))

    # --- stages

    def import_base(self, *paths: str) -> None:
        """Extracts in the PBF format as the base, in place of what there was; the first one's state is where fetching begins."""
        parts = [pbf.read(self.spark, p) for p in paths]
        own = lambda t: ingest.merge_extracts(*[p.filter(F.col("objtype") == t) for p in parts], keep_latest=True)
        self.put_base(own("n").unionByName(own("w")).unionByName(own("r")))
        state = pbf.replication(pbf.paths_of(paths[0])[0])
        if "sequence_number" in state:
            began = osc.State(int(state["sequence_number"]), state.get("timestamp", datetime.fromtimestamp(0, UTC)))
            osc.write_text(self.spark, f"{self.folder}/replication/state.txt", began.text())

    def fetch_changes(self, server: str, size: int = replication.SIZE) -> int:
        """Import the change files that a replication folder has after the project's state, at most `size` bytes; the code says whether there were any.

        The state moves once the queue is written; a run that is lost between the two imports the same files again.
        """
        text = osc.read_text(self.spark, f"{self.folder}/replication/state.txt")
        found = replication.after(self.spark, server, osc.State.parse(text) if text else osc.State(0, datetime.fromtimestamp(0, UTC)), size)
        if found.files:
            self.import_changes(osc.merged_diffs(self.spark, found.files).withColumn("insert_order", F.lit(0)))
            osc.write_text(self.spark, f"{self.folder}/replication/state.txt", found.state.text())
        return found.code

    def import_changes(self, batch: DataFrame) -> None:
        """batch: changes with insert_order."""
        self.put(queue=ingest.import_changes(self.table("queue"), batch))

    def prune(self) -> None:
        self.put(queue=ingest.prune_unknown_deletes(self.table("queue"), self.base))

    def apply_keys(self, keys: DataFrame) -> None:
        """Apply changes of the queue: the base and its geometry get the rows that change, the queue and the journal are written anew.

        The queue goes last, so that a run that is lost before is run again over the same changes.
        """
        steps = self.steps("applied")
        queue, kept = self.table("queue"), self.geometries.current()
        accepted = steps.keep(apply.accepted_changes(queue, steps.keep(keys)))
        if accepted.isEmpty():
            return
        moved = steps.keep(kept.moved(accepted))
        for t, name in KINDS.items():
            table = self.keyed(name)
            table.change(accepted.filter(F.col("objtype") == t).withColumn("gone", F.col("deleted")))
            if table.due():
                table.compact()
        kept.refresh(moved, steps)
        journal, left = steps.keep(apply.journaled(self.table("journal"), accepted)), steps.keep(apply.left_in_queue(queue, accepted))
        self.put(journal=journal)
        self.put(queue=left)
        steps.drop()

    def release(self) -> None:
        """Flag what is of interest, and let through what isn't."""
        c, steps = self.config, self.steps("release")
        base_geom, change_geom = self.shapes()
        found, free = target.release_untargeted(
            self.base, self.table("queue"), base_geom, change_geom, c.rules, steps, target.inside_polygons(c.polygons), c.locha_cluster_distance, self.plane, graph.KeptComponents(self.spark, f"{self.folder}/components")
        )
        found, free = steps.keep(found), steps.keep(free)
        self.put(queue=target.write_back(self.table("queue"), found))
        self.apply_keys(free)

    def fetch_changesets(self, provider: Callable[[DataFrame], DataFrame], now: datetime) -> None:
        """provider: from (id) to changesets."""
        at = F.lit(now.astimezone(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        known = self.table("changesets")
        ids = self.steps("changesets").keep(changesets.missing(self.base, self.table("queue"), known, at))
        self.put(changesets=changesets.upserted(known, provider(ids), at))

    def links(self) -> DataFrame:
        """The queue's links from before to after, in clusters of logical changes."""
        c, steps = self.config, self.steps("links")
        base_geom, change_geom = self.shapes()
        queue = self.table("queue")
        rows = target.enriched(queue, self.base, change_geom, base_geom)
        ids = steps.keep(locha.assign_locha(rows.withColumn("cc_id", F.coalesce("cc_id", "id")), c.locha_cluster_distance, steps, self.plane))
        queue = steps.keep(target.write_back(queue, ids))
        self.put(queue=queue)
        groups = {name: g.polygon for name, g in c.user_groups.items()}
        versions = history.versions(self.base, queue, base_geom, change_geom, self.table("changesets"), groups)
        return steps.keep(history.clustered(history.conflated(history.sides(history.history(versions)), projection=self.plane, steps=steps), steps))

    def validators(self, now: datetime) -> list[validate.Validator]:
        """The configured chain; duplicate and network come with what they find in the tables, delayed with the time."""
        queue, out = self.table("queue"), []
        for name, settings in self.config.validators.items():
            settings, given = dict(settings), {}
            specific = settings.pop("specific", None)
            kind = validate.kind_of(name, settings)
            if kind == "duplicate":
                base_geom, change_geom = self.shapes()
                point = lambda df: df.select("objtype", "id", G.point_on_surface(self.plane.geometry(F.col("geom"))).alias("p")).select("objtype", "id", "p.x", "p.y")
                nodes = self.table("nodes").select(F.lit("n").alias("objtype"), "id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
                base = self.base.select("objtype", "id", "tags").join(point(nodes.unionByName(base_geom.filter("objtype = 'w'"))), ["objtype", "id"])
                own = queue.select("objtype", "id", "locha_id", "deleted", "tags").join(point(change_geom), ["objtype", "id"])
                given["found"] = duplicates.duplicates(base, own, specific)
            if kind == "network":
                given["found"] = network.network_diff(self.table("ways"), self.table("nodes"), queue, specific)
            if kind == "delayed" and "now" not in settings:
                given["now"] = now.astimezone(UTC).replace(tzinfo=None, microsecond=0).isoformat()
            if kind == "tags_changes":
                given["rules"] = self.config.rules + specific if specific else self.config.rules
            out.append(validate.build(name, settings, **given))
        return out

    def validate(self, now: datetime) -> None:
        """Judge the queue, refresh the log, and apply the logical changes of which every link is accepted."""
        steps = self.steps("validate")
        links = self.links()
        judged = validate.validate(links, self.validators(now), self.config.rules)
        at = F.lit(now.astimezone(UTC).replace(tzinfo=None))
        new = steps.keep(validate.log_rows(judged, at))
        free = steps.keep(review.keys_of(new, review.wholly_accepted(new)))
        self.put(log=review.refreshed(self.table("log"), new))
        self.apply_keys(free)

    def accept(self, chosen: DataFrame, uid: int) -> None:
        """Accept by hand: chosen has locha_id, and semantic_group for single groups."""
        log = self.table("log")
        keys = self.steps("accept").keep(review.keys_of(review.pending(log), chosen))
        self.put(log=review.accepted_by_hand(log, chosen, uid))
        self.apply_keys(keys)

    # --- out

    def export(self, path: str) -> None:
        """The whole base: a folder of PBF files if the path ends so, else parquet."""
        if path.endswith(".osm.pbf"):
            pbf.write(self.base, path)
        else:
            export.full_dump(self.base, path)

    def export_update(self, now: datetime) -> bool:
        """The journal as the next numbered diff; the journal is empty then. False if there was nothing."""
        text = osc.read_text(self.spark, f"{self.folder}/export/state.txt")
        state = osc.State.parse(text).next(now) if text else osc.State(1, now)
        if not export.write_osc(self.table("journal"), f"{self.folder}/export/{state.path}.osc.gz"):
            return False
        for where in (f"{state.path}.state.txt", "state.txt"):
            osc.write_text(self.spark, f"{self.folder}/export/{where}", state.text())
        self.put(journal=self.table("journal").limit(0))
        return True

    def export_retained(self, path: str) -> bool:
        """The queue as a diff."""
        return export.write_osc(self.table("queue"), path)

    def changes_logs(self) -> DataFrame:
        """What waits for review, as feature collections."""
        base_geom, change_geom = self.shapes()
        log = self.table("log")
        return review.collections(log, review.features(log, self.base, self.table("queue"), base_geom, change_geom))

    def atom(self, link: str) -> str:
        rows = [r.asDict() for r in self.changes_logs().toLocalIterator()]
        return review.atom(rows, self.config.title.get("en") or next(iter(self.config.title.values())), link)

    def write_atom(self, link: str, path: str) -> None:
        """The feed of what waits for review as a file."""
        review.write_atom(self.changes_logs(), self.config.title.get("en") or next(iter(self.config.title.values())), link, path)

    def overpass(self, text: str) -> DataFrame:
        n, r, kept = self.table("nodes"), self.table("relations"), self.geometries.current()
        tag = lambda df, t: df.select(F.lit(t).alias("objtype"), "id", "geom")
        geom = tag(points(n), "n").unionByName(tag(kept.lines.read(), "w")).unionByName(tag(kept.areas.read(), "r"))
        areas = shapes.areas(r, geom.filter("objtype = 'w'").select("id", "geom")).join(r.select("id", "tags"), "id").withColumn("id", overpass.area_id(F.col("id")))
        return overpass.query(self.base.join(geom, ["objtype", "id"], "left"), text, areas)

    def listing(self) -> DataFrame:
        return review.pending_count(self.table("log")).select(F.lit(self.folder).alias("project"), "pending")

    def check_integrity(self) -> None:
        apply.check_empty(apply.missing_nodes(self.table("ways"), self.table("nodes")), "a way lists a node that isn't there")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def vacuum(self, keep: int = 8) -> None:
        """Remove versions of tables before the last `keep` ones: between updates, once no reader needs them."""
        kept = self.geometries
        for table in (kept.nodes, kept.ways, kept.relations, kept.lines, kept.areas):
            table.vacuum(keep)
        for name in TABLES.keys() - set(KINDS.values()):
            apply.forget(self.spark, f"{self.folder}/{name}", keep)

    def update(self, batch: DataFrame, provider: Callable[[DataFrame], DataFrame] | None, now: datetime) -> None:
        """One whole update."""
        before = len(self.open_steps)
        self.import_changes(batch)
        self.prune()
        self.release()
        if provider:
            self.fetch_changesets(provider, now)
        self.validate(now)
        self.export_update(now)
        self.vacuum()
        for steps in self.open_steps[before:]:
            steps.drop()
        del self.open_steps[before:]
