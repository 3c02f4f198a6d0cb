"""Large tables keyed by id that take small updates, read as a merge.

A table is a folder of parquet: generations, whose rows are dealt to buckets of 2^bits ids, so that no bucket has more rows
than that; and deltas, the changed rows of one update each. A manifest, a small file with a number, names what counts; it is
put in place last, by a rename, so that a reader sees one version, and a write that is lost leaves files that nothing names.
Reading leaves buckets that no delta touches as they are, and takes the rest without the ids that a delta has, with their last
state beside. Compaction writes the touched buckets anew as a generation; files that only older manifests name stay for readers
until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.operators.ingest import last_of
from terravet.plans.tables import unsent

#: Ids of a bucket, as a power of two.
BITS = 20
#: Files of a bucket, as a power of two.
PARTS = 3
#: Deltas, share of the rows that they may have, and generations, beyond which compaction is due.
DELTAS, SHARE, GENERATIONS = 16, 0.1, 8


@dataclass
class Manifest:
    """number: of the manifest. state: counts what changes the rows, which compaction doesn't. notes: what the writer keeps beside."""

    number: int = 0
    state: int = 0
    bits: int = BITS
    generations: list[dict] = field(default_factory=list)
    deltas: list[dict] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    @staticmethod
    def rows(g: dict) -> int:
        """Rows of a generation that count."""
        dead = set(g["dead"])
        return sum(n for b, n in zip(g["buckets"], g["counts"]) if b not in dead)

    def touched(self) -> list[int]:
        return sorted({b for d in self.deltas for b in d["buckets"]})


class KeyedTable:
    """A table of rows (schema, with a long id that no two rows share and that isn't null) under one folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bits: int = BITS):
        self.spark, self.path, self.schema, self.bits = spark, path, schema, bits
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, path) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The manifest of a number, the last one by default; None without any."""
        found = self._numbers()
        if not found:
            return None
        stream = self.fs.open(self._at(f"manifest-{found[-1] if number is None else number}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> None:
        """Put the next manifest in its place; another writer that was first makes this one fail."""
        m.number += 1
        to, by = self._at(f"manifest-{m.number}.json"), self._at(f"_{uuid.uuid4().hex}")
        stream = self.fs.create(by, False)
        stream.write(bytearray(json.dumps(m.__dict__).encode()))
        stream.close()
        if self.fs.exists(to) or not self.fs.rename(by, to):
            self.fs.delete(by, False)
            raise RuntimeError(f"{self.path}: version {m.number} was written meanwhile")

    # --- reading

    def _bucket(self, bits: int) -> Column:
        return F.shiftright(F.col("id"), bits)

    def _generations(self, m: Manifest, among: list[int] | None, without: list[int]) -> DataFrame:
        """Rows of the generations, of the buckets `among` (None: all), without others."""
        out = None
        for g in m.generations:
            rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])).parquet(f"{self.path}/{g['name']}")
            dead = sorted({*g["dead"], *without})
            if among is not None:
                rows = rows.filter(F.col("bucket").isin([b for b in among if b not in dead]))
            elif dead:
                rows = rows.filter(~F.col("bucket").isin(dead))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if out is None else out.select(*self.schema.names)

    def _last(self, m: Manifest) -> DataFrame:
        """The last state of each id in the deltas, with gone."""
        kind = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("seq", T.LongType())])
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{d['name']}" for d in m.deltas])
        return (last_of(rows, ["id"], F.col("seq")) if len(m.deltas) > 1 else rows).drop("seq")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of a number that is still there; no rows without any version."""
        m = self.manifest(number)
        if m is None:
            return self.spark.createDataFrame([], self.schema)
        if not m.deltas:
            return self._generations(m, None, [])
        return self._generations(m, None, m.touched()).unionByName(self._merged(m))

    def _merged(self, m: Manifest) -> DataFrame:
        """The rows of the buckets that deltas touch."""
        last = self._last(m)
        ids = unsent(last.select("id"), rows=sum(d["rows"] for d in m.deltas))
        kept = self._generations(m, m.touched(), []).join(ids, "id", "left_anti")
        return kept.unionByName(last.filter("NOT gone").select(*self.schema.names))

    # --- writing

    def _typed(self, rows: DataFrame, *more: str) -> DataFrame:
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return rows.select(*cols, *more)

    def _write(self, rows: DataFrame, bits: int) -> dict:
        """A generation of these rows, each bucket in some files of an id range, by id, so that a task has a part of a bucket only."""
        name = f"rows-{uuid.uuid4().hex}"
        placed = self._typed(rows).withColumn("bucket", self._bucket(bits)).repartition(self._bucket(max(bits - PARTS, 0))).sortWithinPartitions("bucket", "id")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        some = any(n.startswith("bucket=") for n in self._names(self._at(name)))
        counted = sorted((r["bucket"], r["count"]) for r in self.spark.read.parquet(f"{self.path}/{name}").groupBy("bucket").count().collect()) if some else []
        return {"name": name, "buckets": [b for b, _ in counted], "counts": [n for _, n in counted], "dead": []}

    def replace(self, rows: DataFrame, notes: dict | None = None) -> None:
        """These rows in place of all. rows may be read from this table."""
        m = self.manifest() or Manifest(bits=self.bits)
        g = self._write(rows, m.bits)
        self._publish(Manifest(m.number, m.state + 1, m.bits, [g] if g["buckets"] else [], [], m.notes if notes is None else notes))

    def change(self, rows: DataFrame, notes: dict | None = None) -> int:
        """One update: rows (schema, and gone: whether the id goes), an id at most once. Writes these rows only, and says how many there are."""
        m = self.manifest() or Manifest(bits=self.bits)
        name = f"delta-{uuid.uuid4().hex}"
        self._typed(rows, "gone").withColumn("seq", F.lit(m.number + 1).cast("long")).write.parquet(f"{self.path}/{name}")
        counted = self.spark.read.parquet(f"{self.path}/{name}").groupBy(self._bucket(m.bits).alias("b")).count().collect()  # a row for each bucket at most
        n = sum(r["count"] for r in counted)
        if not n:
            self.fs.delete(self._at(name), True)
            if notes is None or notes == m.notes:
                return 0
        else:
            m.deltas.append({"name": name, "rows": n, "buckets": sorted(r["b"] for r in counted)})
            m.state += 1
        m.notes = m.notes if notes is None else notes
        self._publish(m)
        return n

    def due(self) -> bool:
        """Whether compaction pays: many deltas or generations, or deltas of many rows."""
        m = self.manifest()
        if m is None or not m.deltas:
            return False
        return len(m.deltas) > DELTAS or len(m.generations) > GENERATIONS or sum(d["rows"] for d in m.deltas) > SHARE * sum(map(m.rows, m.generations))

    def compact(self) -> None:
        """Write the buckets that deltas touch anew; with too many generations, those of all but the largest generation too."""
        m = self.manifest()
        if m is None or not m.deltas:
            return
        touched, rows = set(m.touched()), self._merged(m)
        if len(m.generations) > GENERATIONS:
            largest = max(m.generations, key=m.rows)
            more = {b for g in m.generations if g is not largest for b in g["buckets"] if b not in g["dead"]} - touched
            rows, touched = rows.unionByName(self._generations(m, sorted(more), [])), touched | more
        new = self._write(rows, m.bits)
        old = [g | {"dead": sorted({*g["dead"], *(touched & set(g["buckets"]))})} for g in m.generations]
        m.generations = [g for g in old if len(g["dead"]) < len(g["buckets"])] + ([new] if new["buckets"] else [])
        m.deltas = []
        self._publish(m)

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only manifests before the last `keep` name, and what none names; no write may be under way."""
        numbers = self._numbers()
        named = {x["name"] for n in numbers[-keep:] for m in [self.manifest(n)] for x in (*m.generations, *m.deltas)}
        named |= {f"manifest-{n}.json" for n in numbers[-keep:]}
        for name in self._names(self.root):
            if name not in named:
                self.fs.delete(self._at(name), True)
