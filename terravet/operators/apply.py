"""Accepted changes into the base, the journal and the queue. Tables are values: each step gives the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY, VERSION_KEY


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in this order."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("f")).select("f.*")


def accepted_changes(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the queue whose (objtype, id, version, deleted) is in keys, once each."""
    return first_of(queue.join(keys.select(*VERSION_KEY).distinct(), VERSION_KEY, "left_semi"), OBJECT_KEY, F.col("version"))


def _like_base(changes: DataFrame, base: DataFrame) -> DataFrame:
    return changes.select(*[F.col(c) if c in changes.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])


def upserted(base: DataFrame, accepted: DataFrame) -> DataFrame:
    """The base (with objtype) with accepted living changes written over it."""
    new = accepted.filter("NOT deleted")
    return base.join(new.select(*OBJECT_KEY), OBJECT_KEY, "left_anti").unionByName(_like_base(new, base))


def without_deleted(base: DataFrame, accepted: DataFrame) -> DataFrame:
    return base.join(accepted.filter("deleted").select(*OBJECT_KEY), OBJECT_KEY, "left_anti")


def applied(base: DataFrame, accepted: DataFrame) -> DataFrame:
    """The base with accepted changes (an object at most once) written over it, without the deleted ones: upserted and without_deleted in one pass over the base."""
    hit = accepted.filter("deleted IS NOT NULL").select(*OBJECT_KEY)
    return base.join(hit, OBJECT_KEY, "left_anti").unionByName(_like_base(accepted.filter("NOT deleted"), base))


def journaled(journal: DataFrame, accepted: DataFrame) -> DataFrame:
    """The journal with the accepted changes; a version that is there stays as it is."""
    new = first_of(accepted, VERSION_KEY, F.col("version")).join(journal.select(*VERSION_KEY), VERSION_KEY, "left_anti")
    return journal.unionByName(new.select(journal.columns))


def left_in_queue(queue: DataFrame, accepted: DataFrame) -> DataFrame:
    return queue.join(accepted.select(*VERSION_KEY), VERSION_KEY, "left_anti")


def apply_changes(base: DataFrame, queue: DataFrame, journal: DataFrame, keys: DataFrame, steps: Steps | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, queue and journal after the changes in keys (objtype, id, version, deleted). steps: where the accepted rows are written, so that they are found once."""
    accepted = accepted_changes(queue, keys)
    accepted = steps.keep(accepted) if steps else accepted
    return applied(base, accepted), left_in_queue(queue, accepted), journaled(journal, accepted)


def set_aside(table: DataFrame, path: str) -> str:
    """Write a version of a table beside those before it. It counts once its pointer, an empty file named after it, is there."""
    spark: SparkSession = table.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    n = 1 + max([int(x[1:].split(".")[0]) for x in names if x[:1] == "v" and x[1:].split(".")[0].isdigit()], default=0)
    version = f"{path}/v{n}"
    table.write.parquet(version)
    fs.create(fs_path(f"{version}.current"), False).close()
    return version


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of a table that has a pointer; None without any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    known = [int(x[1:-8]) for x in names if x.endswith(".current") and x[1:-8].isdigit()]
    return spark.read.parquet(f"{path}/v{max(known)}") if known else None


def forget(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Remove the versions of a table before its last `keep` ones; no writer may be at work, and readers of older ones lose them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    known = sorted(int(x[1:-8]) for x in names if x.endswith(".current") and x[1:-8].isdigit())
    for n in known[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}.current"), False)
    for name in names:
        number = name[1:].split(".")[0]
        if name[:1] == "v" and number.isdigit() and known and int(number) < known[-keep:][0]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


# --- integrity


def missing_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, node): references of base ways to nodes that the base lacks."""
    refs = ways.select(F.col("id").alias("way"), F.explode("nodes").alias("node"))
    return refs.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("way", "node")


def still_referenced(deleted_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node): deleted nodes (id) that a way still lists."""
    refs = ways.select(F.explode("nodes").alias("node"))
    return deleted_nodes.select(F.col("id").alias("node")).join(refs, "node", "left_semi")


def missing_members(relations: DataFrame, base: DataFrame) -> DataFrame:
    """(relation, type, ref): members that the base lacks."""
    refs = relations.select(F.col("id").alias("relation"), F.explode("members").alias("m")).select("relation", "m.type", "m.ref")
    return refs.join(base.select(F.col("objtype").alias("type"), F.col("id").alias("ref")), ["type", "ref"], "left_anti").select("relation", "type", "ref")


def difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted with their number, and on which side; none if they are equal. Each table is read once."""
    counted = expected.withColumn("__n", F.lit(1)).union(found.withColumn("__n", F.lit(-1)))
    more = counted.groupBy(*expected.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    each = more.withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))))
    return each.select(*expected.columns, F.when(F.col("__n") > 0, "expected").otherwise("found").alias("side"))


def check_empty(rows: DataFrame, what: str) -> None:
    """Raise with the first row if there is any."""
    if first := rows.limit(1).collect():
        raise ValueError(f"{what}: {first[0].asDict()}")
