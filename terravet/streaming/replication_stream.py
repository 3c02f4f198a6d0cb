"""Updates from a replication folder as a stream: change files by their numbers, admitted by bytes.

The stream carries names of files, not rows: a micro-batch is a few names, whose files the executors then read as XML. Spark's
checkpoint knows the files taken; the project's state knows the number reached, which moves once an update is done.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terravet.plans.project import Project
from terravet.sources import osc, replication

NUMBER = re.compile(r"(\d{3})/(\d{3})/(\d{3})\.osc\.gz$")
FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, server: str, size: int = replication.SIZE) -> DataFrame:
    """(path, length) of the change files of a server's folder as they come, at most `size` bytes at once, but at least one file."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxBytesPerTrigger", size).option("pathGlobFilter", "*.osc.gz")
    return files.load(f"{server}/*/*").select("path", "length")


def number_of(path: str) -> int:
    found = NUMBER.search(path)
    if not found:
        raise ValueError(f"{path}: no number of a change file")
    return int("".join(found.groups()))


def update_batch(project: Project, provider: Callable[[DataFrame], DataFrame] | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: one update with the files that go on from the project's state.

    Numbers that the state has passed were taken before a loss and are left out. A number that is missing raises
    FileNotFoundError, as what follows it can't be applied; the state stays, so that the batch is tried again.
    """
    spark, at = project.spark, f"{project.folder}/replication/state.txt"

    def run(batch: DataFrame, _: int) -> None:
        paths = sorted((number_of(r["path"]), r["path"]) for r in batch.select("path").collect())  # names, bounded by the bytes of their files
        text = osc.read_text(spark, at)
        state = osc.State.parse(text) if text else osc.State(0, datetime.fromtimestamp(0, UTC))
        new = [(n, p) for n, p in paths if n > state.sequence]
        for expected, (n, p) in enumerate(new, state.sequence + 1):
            if n != expected:
                raise FileNotFoundError(f"{p}: change file {expected} is missing")
        if not new:
            return
        last, path = new[-1]
        project.update(osc.merged_diffs(spark, [p for _, p in new]).withColumn("insert_order", F.lit(0)), provider, now())
        beside = osc.read_text(spark, path.removesuffix(".osc.gz") + ".state.txt")
        osc.write_text(spark, at, (osc.State.parse(beside) if beside else osc.State(last, now())).text())

    return run


def start(project: Project, server: str, checkpoint: str, size: int = replication.SIZE, provider: Callable[[DataFrame], DataFrame] | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> StreamingQuery:
    """Take what is there in batches of at most `size` bytes and stop; with the same checkpoint it goes on where it stopped."""
    stream = file_stream(project.spark, server, size)
    return stream.writeStream.foreachBatch(update_batch(project, provider, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
