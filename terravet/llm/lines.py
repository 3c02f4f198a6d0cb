"""Fuzzy line dedup: shingles of characters, MinHash banding, exact verification, one line kept of each component.

A line's identity is a 128-bit hash of its small-letter bytes, so that exact copies are one item from the start. A task
sends each line on once for every FLUSH bytes of band keys it makes, so that a very common line is a few entries a task;
its entries travel in packed arrays, one for each range of keys, and are sorted by numpy where they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, encoded, joined, slices, small
from .near import Circulant, Threshold, byte_sets, linked

BANDS, ROWS, BITS = 16, 4, 16
#: Unless told otherwise, lines with fewer bytes are left alone: they carry a document's form rather than its content.
MIN_BYTES = 12
SHINGLE = 8
#: Stretches hashed at a time.
STRETCH = 1 << 15
SIMILAR = Threshold(80, 100)
#: Bytes of entries that a task gathers before it sends them on, and that it sorts at a time.
FLUSH = 48 << 20
#: Packed arrays that a gathering is dealt to, for each shuffle partition.
SPREAD = 8


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with small letters, and of each line: start, end, text it is in, number from 0."""
    data, _, ends = joined(texts)
    data = LOWER[data]
    stops = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    row = np.searchsorted(ends, stops)
    first = np.searchsorted(row, np.arange(len(texts)))
    return data, starts, stops, row, np.arange(len(stops)) - first[row]


def identities(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(lines, 2) numbers: a 128-bit hash of each line."""
    whole = data.tobytes()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]), np.int64).reshape(-1, 2)


def binary(ids: np.ndarray) -> pa.Array:
    """The same as an Arrow array of 16 bytes each."""
    offsets = np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def least_of(made: Circulant, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Signatures of lines of at least SHINGLE bytes."""
    grams = np.ndarray((max(0, len(data) - SHINGLE + 1),), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.empty((len(starts), made.k), made.shifted.dtype)
    first, end, places = 0, 0, np.zeros(0, np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
        if not first <= a < b - SHINGLE + 1 <= end:  # places of the next stretch, small enough for a cache
            first, end = a, max(b - SHINGLE + 1, min(a + STRETCH, len(grams)))
            places = made.places(grams[first:end])
        out[i] = made.least(places[a - first : b - SHINGLE + 1 - first])
    return out


def entries(docs: DataFrame, least: int, parts: int) -> DataFrame:
    """(part, entries): band key and line of each bucket entry, three numbers each, by range of keys; lines below a stretch are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Circulant(BANDS, ROWS, BITS)
        seen: set[bytes] = set()
        keys, lines, held = [], [], 0

        def packed() -> pa.RecordBatch:
            key = np.concatenate(keys)
            rows = np.column_stack([key.ravel(), np.repeat(np.concatenate(lines), made.bands, axis=0)])
            part = (rows[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            blobs = [rows[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blobs, pa.binary())], ["part", "entries"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                data, starts, stops, _, _ = cut(encoded(batch.column(0).slice(a, b - a)))
                long = stops - starts >= max(least, SHINGLE)
                starts, stops = starts[long], stops[long]
                ids = identities(data, starts, stops)
                new = []
                for i, name in enumerate(ids.view("V16").ravel().tolist()):
                    if name not in seen:
                        seen.add(name)
                        new.append(i)
                if new:
                    keys.append(made.band_keys(least_of(made, data, starts[new], stops[new])))
                    lines.append(ids[new])
                    held += keys[-1].size * 24
                if held >= FLUSH:
                    yield packed()
                    seen, keys, lines, held = set(), [], [], 0
        if held:
            yield packed()

    return docs.select("text").mapInArrow(run, "part int, entries binary")


def buckets(packed: DataFrame, parts: int, flush: int = FLUSH) -> DataFrame:
    """(key, id, pivot) of each line in a bucket with others, but the one first met, which is the bucket's pivot.

    Entries come part by part. A task sorts `flush` bytes of them at a time and holds the pivots of the part that it is in; it holds no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros((0, 3), np.int64)

        def met(blobs: list[bytes], part: int) -> pa.RecordBatch:
            """Of known pivots, those of the last part that was met go on."""
            nonlocal known
            rows = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)
            rows = np.concatenate([known, rows])  # a stable sort leaves known pivots first
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            first = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            known = rows[first]
            pivot = known[np.cumsum(first) - 1]
            known = known[known[:, 0].view(np.uint64) % np.uint64(parts) == np.uint64(part)]
            other = (rows[:, 1:] != pivot[:, 1:]).any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(rows[other, 0]), binary(rows[other, 1:]), binary(pivot[other, 1:])], ["key", "id", "pivot"])

        held, size = [], 0
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(blob)
                size += len(blob)
                if size >= flush:
                    yield met(held, part)
                    held, size = [], 0
        if held:
            yield met(held, part)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, id binary, pivot binary").distinct()


def places(docs: DataFrame, least: int) -> DataFrame:
    """(id, doc_id, line) of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, starts, stops, row, number = cut(encoded(batch.column(1).slice(a, b - a)))
                long = stops - starts >= least
                ids = identities(data, starts[long], stops[long])
                yield pa.RecordBatch.from_arrays([binary(ids), batch.column(0).slice(a, b - a).take(pa.array(row[long])), pa.array(number[long].astype(np.int32))], ["id", "doc_id", "line"])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, "id binary, doc_id long, line int")


def texts_of(docs: DataFrame, where: DataFrame) -> DataFrame:
    """(id, text) of lines (id, first: where each is first met), read from the documents by number; an id once."""
    lists = where.groupBy("first.doc_id").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "id")).alias("at"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n", -1).alias("lines")).join(lists, "doc_id")
    picked = rows.select("lines", F.explode("at").alias("at"))
    return picked.select("at.id", F.get("lines", F.col("at.line")).alias("text")).dropDuplicates(["id"])


def removals(docs: DataFrame, scratch: Scratch, least: int = MIN_BYTES) -> DataFrame:
    """(doc_id, lines array<int>): the numbers of each document's lines that another line stands for."""
    parts = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch.inner() as own:
        met = own.save(buckets(entries(docs.filter("doc_id IS NOT NULL"), least, parts), parts))
        members = own.save(met.union(met.select("key", F.col("pivot").alias("id"), "pivot").distinct()))
        every = own.save(places(docs, least))
        at = F.struct("doc_id", "line")
        # Of the distinct lines only those go on that are repeated or share a bucket.
        counted = every.groupBy("id").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
        counted = counted.join(members.select("id").distinct().withColumn("member", F.lit(True)), "id", "left")
        counted = own.save(counted.filter("n > 1 OR member").select("id", "first", F.coalesce("member", F.lit(False)).alias("member"), "n"))
        texts = own.save(texts_of(docs, counted.filter("member")))
        found = linked(members, texts, byte_sets(), SIMILAR, own)
        named = counted.join(found, "id", "left").filter("n > 1 OR component IS NOT NULL")
        named = own.save(named.select("id", "first", F.coalesce("component", "id").alias("component")))
        keeper = named.groupBy("component").agg(F.min("first").alias("keeper"))
        owners = named.join(keeper, "component").select("id", "keeper")
        gone = every.join(owners, "id").filter(at != F.col("keeper"))
        return scratch.save(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def flagged(gone: DataFrame) -> DataFrame:
    """(doc_id, __stays, n): for each line up to the last that goes, whether it stays; and how many go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for numbers in batch.column(1).to_pylist():
                stays = np.ones(numbers[-1] + 1, bool)
                stays[numbers] = False
                rows.append(stays)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.bool_())), pa.array([int((~r).sum()) for r in rows], pa.int32())], ["doc_id", "__stays", "n"])

    return gone.mapInArrow(run, "doc_id long, __stays array<boolean>, n int")


def dedup_lines(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without the lines that another line stands for; adds n_removed.

    Lines of at least `least` bytes (1 or more) whose sets of 8-byte stretches (small letters) have a Jaccard similarity of 0.8 or
    more are linked, equal lines always, and lines below 8 bytes only if equal; of each component the line at the smallest (doc_id, line number) stays. Shorter
    and empty lines stay. A null text has no lines and stays null, an empty text has one, empty line. A column n_removed of docs
    is replaced. doc_id is a key: repeated rows count as one document and each loses the same lines; a
    row with a null doc_id is left as it is. Lines of any length are compared whole.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    given = [c for c in docs.columns if c != "n_removed"]
    gone = scratch.save(flagged(removals(docs.select("doc_id", "text"), scratch, least))).select(F.col("doc_id").alias("__id"), "__stays", F.col("n").alias("__n"))
    side = small(gone, 64 + F.size("__stays"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))  # as one column, so that no name of docs is met again
    of = lambda c: F.col("row")[c]
    out = base.join(side, of("doc_id").cast("long") == F.col("__id"), "left")
    lines = F.split(of("text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get(F.col("__stays"), i), F.lit(True)))
    text = F.when(F.col("__stays").isNull(), of("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[(text if c == "text" else of(c)).alias(c) for c in given],
        F.when(of("text").isNull(), 0).otherwise(F.coalesce("__n", F.lit(0))).alias("n_removed"),
    )
