"""Media columns with content-defined payload chunking.

A payload is kept as the samples of a grey image, 576 to a row. The stored bytes are cut where a rolling gear hash of the
last 32 bytes says so; equal chunks are stored once, found by joins on their digests; a medium is the ordered list of its
chunks. What is stored is a table of packs, which hold the chunks that one medium owns, and a table of lists; a medium that
owns all its chunks is read from its pack, others by joining their chunks in order, each checked against its digest.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, encoded, slices, small
from .near import grouped

ROW = 576
#: Chunk sizes: least, about the mean beyond the least, most.
LEAST, BITS, MOST = 2048, 13, 65536
GEAR = np.random.default_rng(41).integers(0, 1 << 32, 256, dtype=np.uint32)


def to_media(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload's bytes; the payload is a multiple of ROW bytes."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_media(media: bytes) -> bytes:
    """The samples of to_media; raises ValueError if the header and the samples don't agree."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a stored image")
    return samples


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of ROW."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\xff")


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash sum of GEAR[byte] << age over the 32 bytes that end there, modulo 2^32."""
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h = longer
    return h


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data end; they depend on nothing else."""
    n = len(data)
    if n <= LEAST:
        return [n]
    at = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    at, out, start = at.tolist(), [], 0
    while n - start > LEAST:
        i = bisect_left(at, start + LEAST)
        end = min(at[i] if i < len(at) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunked(data: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk, in order."""
    ends = cuts(data)
    parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    return [(hashlib.blake2b(p, digest_size=16).digest(), p) for p in parts]


def name_of(digests: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(digests), digest_size=16).digest()


def key_of(docs: DataFrame) -> Column:
    """What names a row: its id, or where that is null, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def lists(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_bytes, medium, digests): for every row the name of its medium and the ordered digests of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                raw = encoded(batch.column(2).slice(a, b - a))
                found = [[d for d, _ in chunked(to_media(padded(x)))] for x in raw]
                cols = [*[c.slice(a, b - a) for c in batch.columns[:2]], pa.array([len(x) for x in raw], pa.int64()), pa.array([name_of(x) for x in found], pa.binary()), pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "n_bytes", "medium", "digests"])

    rows = docs.select(key_of(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "key string, doc_id long, n_bytes long, medium binary, digests array<binary>")


def packs(rows: DataFrame) -> DataFrame:
    """(medium, whole, places, digests, chunks) of rows (text, lacks): the chunks of each medium but those at the places it lacks; whole if it lacks none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                names, whole, places, digests, chunks = [], [], [], [], []
                for x, lacks in zip(encoded(batch.column(0).slice(a, b - a)), batch.column(1).slice(a, b - a).to_pylist()):
                    parts, lacks = chunked(to_media(padded(x))), set(lacks or ())
                    own = [i for i in range(len(parts)) if i not in lacks]
                    if own:
                        names.append(name_of([d for d, _ in parts]))
                        whole.append(len(own) == len(parts))
                        places.append(own)
                        digests.append([parts[i][0] for i in own])
                        chunks.append([parts[i][1] for i in own])
                cols = [pa.array(names, pa.binary()), pa.array(whole, pa.bool_()), pa.array(places, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary())), pa.array(chunks, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["medium", "whole", "places", "digests", "chunks"])

    return rows.select("text", "lacks").mapInArrow(run, "medium binary, whole boolean, places array<int>, digests array<binary>, chunks array<binary>")


def features(samples: bytes) -> str:
    """Rows, least, greatest and summed sample, and a 64-bit hash of which of 64 stretches are brighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    bounds = np.linspace(0, len(x), 65).astype(np.int64)
    sums = np.add.reduceat(x.astype(np.int64), bounds[:-1])
    total = int(sums.sum())
    bits = sums * len(x) > total * np.diff(bounds)
    return f"rows={len(x) // ROW};min={x.min()};max={x.max()};sum={total};hash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The media of docs: lists (key, doc_id, n_bytes, medium, digests), packs (medium, whole, places, digests, chunks), and
    where the chunks that a medium lacks are: (medium, place, digest, owner).

    Of equal media the row with the least key is stored; of equal chunks the one at the least medium and place. Only rows that
    don't own all their chunks have to be told so. Rows that repeat a key repeat their pack.
    """
    kept = scratch.save(lists(docs))
    with scratch.inner() as own:
        media = own.save(kept.groupBy("medium").agg(F.min("key").alias("key"), F.min_by("digests", "key").alias("digests")))
        refs = own.save(media.select("medium", F.posexplode("digests").alias("place", "digest")))
        owners = refs.groupBy("digest").agg(F.min(F.struct("medium", "place")).alias("own"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "own")
        lent = refs.join(owners, "digest").filter(F.struct("medium", "place") != F.col("own"))
        lent = scratch.save(lent.select("medium", "place", "digest", F.col("own.medium").alias("owner")))
        lacking = lent.groupBy("medium").agg(F.collect_set("place").alias("lacks"))
        lacking = media.join(lacking, "medium").select("key", "lacks")
        # A row whose medium another row stores lacks every place.
        copies = kept.join(media.select("medium", F.col("key").alias("of")), "medium").filter("key <> of").select("key", F.sequence(F.lit(0), F.size("digests") - 1).alias("lacks"))
        told = own.save(lacking.union(copies.dropDuplicates(["key"])).withColumnRenamed("key", "__key"))
        # Where these are few, the texts need not move for them.
        told = small(told, 48 + F.octet_length("__key") + 8 * F.size("lacks"))
        rows = docs.select(key_of(docs).alias("key"), "text").join(told, F.col("key") == F.col("__key"), "left")
        return kept, scratch.save(packs(rows)), lent


MEDIUM = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def whole_medium(medium: bytes, digests: list[bytes], chunks: list[bytes]) -> list:
    """A row of MEDIUM; raises ValueError for a chunk that doesn't have its digest, or a list that doesn't give the medium's name."""
    for d, x in zip(digests, chunks):
        if hashlib.blake2b(x, digest_size=16).digest() != d:
            raise ValueError(f"chunk {d.hex()} is damaged")
    if name_of(digests) != medium:
        raise ValueError(f"medium {medium.hex()} lacks chunks")
    media = b"".join(chunks)
    payload = from_media(media)
    return [medium, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)]


def table_of(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in MEDIUM.split(", ")])


def read_back(stored: DataFrame, lent: DataFrame) -> DataFrame:
    """A row of MEDIUM for each medium, from the stored packs and, for chunks that others own, from theirs."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 64):  # names of 16 bytes: four media at a time
                part = batch.slice(a, b - a)
                yield table_of([whole_medium(*row) for row in zip(*[c.to_pylist() for c in part.columns])])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for medium, place, digest, chunk in grouped(batches, 1):
            first = [i for i in range(len(place)) if not i or place[i] != place[i - 1]]  # repeated packs repeat chunks
            yield table_of([whole_medium(medium[0], [digest[i] for i in first], [chunk[i] for i in first])])

    single = stored.filter("whole").select("medium", "digests", "chunks").mapInArrow(alone, MEDIUM)
    need = lent.select("medium").union(lent.select("owner")).distinct()
    each = stored.join(need, "medium", "left_semi").select("medium", "whole", F.explode(F.arrays_zip("places", "digests", "chunks")).alias("c"))
    each = each.select("medium", "whole", F.col("c.places").alias("place"), F.col("c.digests").alias("digest"), F.col("c.chunks").alias("chunk"))
    own = each.filter("NOT whole").select("medium", "place", "digest", "chunk")
    # The owner of a digest holds it at one place or several, with equal bytes.
    others = lent.join(each.select(F.col("medium").alias("owner"), "digest", "chunk"), ["owner", "digest"]).select("medium", "place", "digest", "chunk")
    rows = own.union(others).repartition("medium").sortWithinPartitions("medium", "place")
    return single.union(rows.mapInArrow(together, MEDIUM)).dropDuplicates(["medium"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back of each row's medium: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is the whole text as UTF-8 (null: empty) and bytes 255 up to a positive multiple of 576. Rows with equal
    texts share a medium, which is stored and read once. Repeated rows and null ids give rows like others; other columns of
    docs go. Texts of any length are chunked; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "media")
    kept, stored, lent = store(docs, scratch)
    back = scratch.save(read_back(stored, lent))
    return kept.select("doc_id", "n_bytes", "medium").join(back, "medium").drop("medium")
