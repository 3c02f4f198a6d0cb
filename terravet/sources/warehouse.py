"""The domain tables read from a star schema of parts, orders, customers and events; whole numbers only, so that any engine agrees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravet.operators.ingest import last_of
from terravet.operators.views import base_view, typed
from terravet.plans.tables import Steps, importable

CREATED, UNKNOWN = 1_000_000_000, 2_000_000_000
CHANGE_COLUMNS = ["objtype", "id", "version", "deleted", "changeset_id", "created", "uid", "username", "tags", "lon", "lat", "nodes", "members"]


def lon_of(id_: Column) -> Column:
    return ((id_ * 37) % 360 - 180).cast("double")


def lat_of(id_: Column) -> Column:
    return ((id_ * 17) % 170 - 85).cast("double")


def text_map(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


@dataclass
class Warehouse:
    """Base, changes and changesets of one folder of parquet tables."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        importable(self.spark)

    def kept(self, steps: Steps) -> Warehouse:
        """The same with the base and the changes written once, for queries that read them again and again."""
        return self.over(steps.keep(self.nodes), steps.keep(self.ways), steps.keep(self.relations), steps)

    def over(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame, steps: Steps) -> Warehouse:
        """The same on a base that is written already, with its changes written once."""
        own = Warehouse(self.spark, self.folder)
        own.nodes, own.ways, own.relations = nodes, ways, relations
        own.changes = steps.keep(own.changes)
        return own

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        p = self.read("part")
        key = F.col("p_partkey")
        return p.select(
            key.alias("id"), F.lit(1).alias("version"), F.lit(None).cast("int").alias("changeset_id"), F.lit(None).cast("timestamp_ntz").alias("created"), F.lit(None).cast("int").alias("uid"), F.lit(None).cast("string").alias("username"),
            text_map(brand=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size")).alias("tags"), lon_of(key).alias("lon"), lat_of(key).alias("lat"),
        )

    def _order_nodes(self, lines: DataFrame) -> DataFrame:
        lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
        return lists.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("l", lambda s: s["l_partkey"]).alias("nodes"))

    @cached_property
    def ways(self) -> DataFrame:
        lists = self._order_nodes(self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
        rows = self.read("orders").join(lists, "o_orderkey")
        return rows.select(
            F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_custkey").cast("int").alias("changeset_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.col("o_custkey").cast("int").alias("uid"), F.lit(None).cast("string").alias("username"),
            text_map(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("tags"), "nodes",
        )

    @cached_property
    def relations(self) -> DataFrame:
        member = F.struct(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("role"), F.lit("w").alias("type"))
        lists = self.read("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(member)).alias("members"))
        rows = self.read("customer").join(lists, F.col("c_custkey") == F.col("o_custkey"))
        return rows.select(F.col("c_custkey").alias("id"), F.lit(1).alias("version"), text_map(segment=F.col("c_mktsegment")).alias("tags"), "members")

    @cached_property
    def base(self) -> DataFrame:
        return base_view(self.nodes, self.ways, self.relations)

    @cached_property
    def node_events(self) -> DataFrame:
        """Every node change in the order of arrival: insert_order is the event's number."""
        e, n = self.read("events"), F.col("event_id")
        kind = F.col("event_type")
        unknown = (kind == "error") & (n % 10 == 0)
        id_ = F.when(kind == "signup", n + CREATED).when(unknown, n + UNKNOWN).otherwise(F.col("user_id"))
        deleted = kind == "error"
        user = F.col("user_id").cast("int")
        rows = e.select(
            F.lit("n").alias("objtype"), id_.alias("id"), deleted.alias("deleted"), (user * 100 + F.dayofmonth("ts")).cast("int").alias("changeset_id"), F.col("ts").cast("timestamp_ntz").alias("created"), user.alias("uid"), F.concat(F.lit("user"), user.cast("string")).alias("username"),
            F.when(~deleted, text_map(event_type=kind, brand=F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")))).alias("tags"), (lon_of(id_) + n % 7 - 3).cast("double").alias("lon"), (lat_of(id_) + n % 7 - 3).cast("double").alias("lat"), n.alias("insert_order"),
        )
        return typed_change(rows.withColumn("version", (F.lit(2) + F.col("insert_order") % 5).cast("int")), "insert_order")

    @cached_property
    def node_changes(self) -> DataFrame:
        return last_of(self.node_events, ["objtype", "id"], F.col("insert_order")).drop("insert_order")

    @cached_property
    def way_changes(self) -> DataFrame:
        """One order in 200: its references without the returned lines; gone if none is left."""
        lines = self.read("lineitem").filter("l_orderkey % 200 = 0")
        kept = self._order_nodes(lines.filter("l_returnflag <> 'R'"))
        rows = self.ways.filter("id % 200 = 0").drop("nodes").join(kept.withColumnRenamed("o_orderkey", "id"), "id", "left")
        rows = rows.withColumns({"objtype": F.lit("w"), "deleted": F.col("nodes").isNull(), "version": F.lit(2), "username": F.concat(F.lit("user"), F.col("uid").cast("string"))})
        return typed_change(rows)

    @cached_property
    def relation_changes(self) -> DataFrame:
        """One customer in 50: its members without those of role P."""
        rows = self.relations.filter("id % 50 = 0").withColumn("members", F.filter("members", lambda m: m["role"] != "P"))
        return typed_change(rows.withColumns({"objtype": F.lit("r"), "deleted": F.lit(False), "version": F.lit(2)}))

    @cached_property
    def changes(self) -> DataFrame:
        return self.node_changes.unionByName(self.way_changes).unionByName(self.relation_changes)

    @cached_property
    def changesets(self) -> DataFrame:
        e = self.read("events")
        rows = e.groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("id")).agg(
            F.min("ts").cast("timestamp_ntz").alias("created_at"), F.max("ts").cast("timestamp_ntz").alias("closed_at"), F.min("user_id").cast("int").alias("uid"),
            F.count_if(F.col("event_type") == "error").cast("int").alias("comments_count"), F.count(F.lit(1)).cast("int").alias("changes_count"), F.max("value").alias("most"),
        )
        tags = F.when(F.col("most") > 100, text_map(review_requested=F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
        return rows.select("id", "created_at", "closed_at", F.lit(False).alias("open"), F.concat(F.lit("user"), F.col("uid").cast("string")).alias("user"), "uid", "comments_count", "changes_count", tags.alias("tags"), F.col("closed_at").alias("updated_at"))


def typed_change(rows: DataFrame, *more: str) -> DataFrame:
    """rows in the order and types of CHANGE_COLUMNS, with more of their columns."""
    full = typed(rows)
    cols = [F.col(c).cast("boolean") if c == "deleted" else (F.col(c) if c in rows.columns else F.lit(None)).cast(full.schema[c].dataType).alias(c) for c in CHANGE_COLUMNS]
    return rows.select(*cols, *more)
