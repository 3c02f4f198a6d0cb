"""Tables written between the stages of an iteration: they cut the lineage and survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that a join may send whole to every executor, which gathers them on the driver first.
SENT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terravet-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if they have it there too."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def unsent(table: DataFrame, each: Column | None = None, rows: int | None = None) -> DataFrame:
    """A written table, marked for sorting joins if it has more than SENT rows: of a few columns of its files Spark guesses far too little.

    each: into how many rows one is exploded before it is joined. rows: how many these are, where that is known.
    """
    if rows is None:
        rows = table.count() if each is None else table.agg(F.sum(each)).first()[0] or 0
    return table.hint("merge") if rows > SENT else table


class Steps:
    """Numbered tables under one folder of the shared place."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove every table; only once nothing lazy reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
