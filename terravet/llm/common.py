"""What several operators share: scratch tables, Arrow batches, hashing of texts held in one buffer."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast, Spark's own bound.
BROADCAST_BYTES = 10 << 20
#: Bytes of text that the vectorised code works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

#: Rates of a sample by hash are whole numbers out of so many.
RATES = 10**15

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="terravet-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if they have it there too."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class Scratch:
    """Tables written to the shared folder: they cut the lineage, and a lost executor costs nothing that was written.

    What only leads to another table goes to an `inner` scratch, whose tables are removed when its block is left.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root, self.n = spark, f"{root or shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """save() in buckets by a key, so that what is grouped or joined by it comes to these rows, which aren't shuffled again."""
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", f"{self.root}/{self.n}").bucketBy(buckets, key).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files are this scratch's own
        return out

    def inner(self) -> Scratch:
        return Scratch(self.spark, "inner", self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        """Remove every table of this scratch; only once nothing lazy reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rate_of(share: float) -> int:
    """A share as a rate out of RATES, never 0, so that no group of rows is too large to be sampled."""
    return max(1, int(RATES * min(1.0, share)))


def small(df: DataFrame, row: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a saved table for broadcast if its measured bytes, `row` for each row, are below the bound; else leave the join to Spark."""
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array, each of about `most` bytes."""
    n = len(texts)
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array with a gap after each, and where each starts and ends."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + len(gap)) - len(gap)
    return np.frombuffer(gap.join(texts) + gap, np.uint8), ends - lengths, ends


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * MIX2
    return h ^ (h >> np.uint64(33))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE^position modulo 2^64, from which the hash of any stretch follows."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end) of the bytes behind prefix_sums."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX1)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of bytes that are not ASCII white space) of one byte array start and end."""
    inside = np.concatenate([[False], ~IS_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
