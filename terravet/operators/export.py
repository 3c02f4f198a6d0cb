"""Changes as diffs: actions, blocks and text."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravet.plans.tables import Steps

ORDER = ["objtype", "id", "version"]
NAMES = {"n": "node", "w": "way", "r": "relation"}


def classified(rows: DataFrame) -> DataFrame:
    """rows with action: delete, create for first versions, else modify."""
    return rows.withColumn("action", F.when(F.col("deleted"), "delete").when(F.col("version") == 1, "create").otherwise("modify"))


def blocks(rows: DataFrame) -> DataFrame:
    """classified rows with block: consecutive rows of one action in the order of type, id and version share a number from 1."""
    return bounded_blocks(rows).drop("opens", "closes")


def bounded_blocks(rows: DataFrame) -> DataFrame:
    """blocks with opens, whether a row is its block's first, and closes, the action of the block that ends before it, if any does.

    Changes of action are found within ranges of the order; a range's number of new blocks is added up over the ranges, of
    which there are as many as partitions, and never over rows in one task.
    """
    ranged = classified(rows).repartitionByRange(*ORDER).withColumn("__p", F.spark_partition_id())
    own = Window.partitionBy("__p").orderBy(*ORDER)
    marked = ranged.withColumn("__new", F.when(F.lag("action").over(own).eqNullSafe(F.col("action")), 0).otherwise(1))
    # Kept, as the ranges are named twice below and have to be the same both times.
    marked = marked.withColumns({"__n": F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)), "__was": F.lag("action").over(own)})
    marked = Steps(rows.sparkSession, "blocks").keep(marked)
    ends = marked.groupBy("__p").agg(F.max("__n").alias("n"), F.min_by("action", F.struct(*ORDER)).alias("first"), F.max_by("action", F.struct(*ORDER)).alias("last"))
    over = Window.orderBy("__p")
    joins = F.when(F.lag("last").over(over).eqNullSafe(F.col("first")), 1).otherwise(0)
    offsets = ends.withColumns({"__same": joins, "__last": F.lag("last").over(over)}).withColumn("__before", F.coalesce(F.sum(F.col("n")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("__same").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    known = marked.join(F.broadcast(offsets.select("__p", "__before", "__same", "__last")), "__p")  # a row for each partition
    goes_on = (F.col("__n") == 1) & (F.col("__same") == 1)
    opens = (F.col("__new") == 1) & ~goes_on
    known = known.withColumns({"block": (F.col("__n") + F.col("__before")).cast("long"), "opens": opens, "closes": F.when(opens, F.coalesce("__was", "__last"))})
    return known.drop("__p", "__new", "__n", "__before", "__same", "__last", "__was")


def element(row: dict) -> str:
    """XML of one object."""
    head = [f"<{NAMES[row['objtype']]}"]
    created = row.get("created")
    values = {
        "id": row["id"], "version": row.get("version"), "timestamp": None if created is None or pd.isna(created) else pd.Timestamp(created).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "changeset": row.get("changeset_id"), "uid": row.get("uid"), "user": row.get("username"),
    }
    if row["objtype"] == "n":
        values |= {"lat": row.get("lat"), "lon": row.get("lon")}
    for k, v in values.items():
        if v is not None and not (isinstance(v, float) and pd.isna(v)):
            number = isinstance(v, float) and k not in ("lat", "lon")
            head.append(f" {k}={quoteattr(str(int(v)) if number else str(v))}")
    inner = []
    if row["objtype"] == "w":
        inner += [f'<nd ref="{int(n)}"/>' for n in (row.get("nodes") if row.get("nodes") is not None else [])]
    if row["objtype"] == "r":
        members = row.get("members") if row.get("members") is not None else []
        inner += [f'<member type="{NAMES[m["type"]]}" ref="{int(m["ref"])}" role={quoteattr(m["role"] or "")}/>' for m in members]
    tags = row.get("tags")
    inner += [f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in sorted(dict(tags if tags is not None else {}).items())]
    return "".join(head) + ("/>" if not inner else ">" + "".join(inner) + f"</{NAMES[row['objtype']]}>")


def lines(rows: DataFrame) -> DataFrame:
    """(text): the diff's lines in its order, over the partitions; each row with the ends of blocks before it. What ends the last block is left to the foot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                before = ([f"</{r['closes']}>"] if r["closes"] else []) + ([f"<{r['action']}>"] if r["opens"] else [])
                out.append("\n".join([*before, element(r)]))
            yield pd.DataFrame({"text": out})

    return bounded_blocks(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInPandas(run, "text string")


def write_lines(text: DataFrame, head: str, foot: Callable[[], str], path: str, zipped: bool = True) -> None:
    """One file of the lines of text (text), in the order of its partitions, between head and foot.

    Executors write a file for each partition, gzip members if zipped, which put one after another are a gzip file again; the
    driver only copies their bytes, a buffer at a time, beside the place, and renames. foot is asked for once the lines are written.
    """
    spark = text.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    steps = Steps(spark, "lines")
    text.write.option("compression", "gzip" if zipped else "none").text(steps.root)
    pack = (lambda t: gzip.compress(t.encode(), mtime=0)) if zipped else str.encode
    target, beside, parts = hadoop.fs.Path(path), hadoop.fs.Path(path + ".tmp"), hadoop.fs.Path(steps.root)
    fs, own = target.getFileSystem(conf), parts.getFileSystem(conf)
    stream = fs.create(beside, True)
    stream.write(bytearray(pack(head)))
    for part in sorted((s.getPath() for s in own.listStatus(parts)), key=lambda p: p.getName()):
        if part.getName().startswith("part-"):
            piece = own.open(part)
            hadoop.io.IOUtils.copyBytes(piece, stream, 1 << 20, False)
            piece.close()
    stream.write(bytearray(pack(foot())))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path}: can't be put in its place")
    steps.drop()


def write_osc(rows: DataFrame, path: str) -> bool:
    """Write a gzipped diff through Hadoop's file systems; False and no file if there is nothing."""
    if rows.isEmpty():
        return False

    def foot() -> str:
        last = classified(rows).agg(F.max_by("action", F.struct(*ORDER))).first()[0]
        return f"</{last}>\n</osmChange>\n"

    write_lines(lines(rows), '<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6">\n', foot, path)
    return True


def full_dump(base: DataFrame, path: str) -> None:
    """All objects, nodes before ways before relations and by id, as parquet in that order."""
    rank = F.when(F.col("objtype") == "n", 0).when(F.col("objtype") == "w", 1).otherwise(2)
    base.withColumn("__r", rank).repartitionByRange("__r", "id").sortWithinPartitions("__r", "id").drop("__r").write.mode("errorifexists").parquet(path)
