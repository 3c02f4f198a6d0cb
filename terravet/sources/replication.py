"""Fetching change files by sequence number from a replication folder, on any file system that Hadoop can open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from terravet.sources import osc

#: Bytes of change files that one update takes unless told otherwise.
SIZE = 3 << 20
#: Exit codes of the command: something fetched, nothing new.
FETCHED, NOTHING = 0, 3


@dataclass(frozen=True)
class Fetched:
    """Change files in order, and the state that they lead to."""

    files: list[str]
    state: osc.State

    @property
    def code(self) -> int:
        return FETCHED if self.files else NOTHING


def after(spark: SparkSession, server: str, state: osc.State, size: int = SIZE) -> Fetched:
    """The change files of a server's folder after a state, up to its last one or as many as stay within `size` bytes, but at least one.

    The folder holds state.txt, and for each number NNN/NNN/NNN.osc.gz with its state beside it. A number whose file is
    missing raises FileNotFoundError, as what follows it can't be applied.
    """
    latest = osc.read_text(spark, f"{server}/state.txt")
    if latest is None:
        raise FileNotFoundError(f"{server}/state.txt")
    last, jvm = osc.State.parse(latest).sequence, spark._jvm.org.apache.hadoop.fs.Path
    files, total, reached = [], 0, state
    for n in range(state.sequence + 1, last + 1):
        step = osc.State(n, state.timestamp)
        path = jvm(f"{server}/{step.path}.osc.gz")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(str(path))
        total += fs.getFileStatus(path).getLen()
        if files and total > size:
            break
        files.append(f"{server}/{step.path}.osc.gz")
        reached = osc.State.parse(osc.read_text(spark, f"{server}/{step.path}.state.txt") or latest)
    return Fetched(files, reached)
