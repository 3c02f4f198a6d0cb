"""Exact duplicates by Grace hashing: records are dealt to buckets by a hash of their text, and each bucket's task holds an
open-addressing table of complete texts, bounded by TABLE_BYTES.

What a full table can't take goes to a written spill table, of which the next level makes buckets by another hash, so many that
each should fit; so it goes on until nothing is spilled. A text once taken meets all its copies in that bucket, and one that was
spilled is never taken there, as a full table stays full. Copies are met first within the task that reads them, so that a
text with any number of copies goes to its bucket once from each task: what the copies get is joined to them by that one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of text that a bucket is planned for; that its table takes; and that a reading task holds before it begins a new table.
BUCKET_BYTES, TABLE_BYTES, READ_BYTES = 32 << 20, 64 << 20, 16 << 20


class Table:
    """Open addressing with linear probing; entries are complete texts, of which no two are equal."""

    def __init__(self, most: int, slots: int = 1 << 10):
        self.most, self.bytes, self.slots = most, 0, [-1] * slots
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def find(self, h: int, text: bytes) -> int:
        """The number of the text's entry, made if it is new; -1 if it is new and there is no room. An empty table has room for any text."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
            at = (at + 1) & mask
        if self.texts and self.bytes + len(text) > self.most:
            self.most = -1  # nothing new from here on, not even a shorter text
            return -1
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 64
        if 2 * len(self.texts) > len(self.slots):
            self.grow()
        return len(self.texts) - 1

    def grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def sooner(a: tuple, b: tuple) -> tuple:
    """The smaller of two (doc_id, row), a missing id being the largest."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


RECORD = "row long, doc_id long, leader long, h long, bytes long, n long, least long, least_row long, sha string, text binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]


def records(rows: list[tuple], names: list[str] = NAMES, types: list[pa.DataType] = TYPES) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def met(docs: DataFrame, most: int) -> DataFrame:
    """RECORD of every row: of the texts that a task meets again only the first row has a text, with the number and the least row of its copies there; the others name it as leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        table, leaders, held = Table(most), [], []

        def flushed() -> pa.RecordBatch:
            return records([(r, d, r, h, len(t), n, *least, sha, t) for (r, d, h, sha, n, least), t in zip(leaders, table.texts)])

        for batch in batches:
            for doc, h, sha, text in zip(*[c.to_pylist() for c in batch.columns]):
                e = table.find(h, text)
                if e < 0:
                    yield flushed()
                    table, leaders = Table(most), []
                    e = table.find(h, text)
                if e == len(leaders):
                    leaders.append([row, doc, h, sha, 1, (doc, row)])
                else:
                    own = leaders[e]
                    own[4], own[5] = own[4] + 1, sooner(own[5], (doc, row))
                    held.append((row, doc, own[0], None, None, None, None, None, None, None))
                row += 1
            if held:
                yield records(held)
                held = []
        if leaders:
            yield flushed()

    # A single space stays as it is, so only other runs are matched.
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return given.select("doc_id", F.xxhash64("t"), F.sha2(F.col("t").cast("binary"), 256), F.col("t").cast("binary")).mapInArrow(run, RECORD)


SOLVED = "keep_id long, keep_row long, size long"


def solved(dealt: DataFrame, most: int) -> DataFrame:
    """RECORD and SOLVED: what the table of a partition has taken, without text; and, as they came, the records that it had no room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, groups, taken = Table(most), [], []
        names, types = [*NAMES, "keep_id", "keep_row", "size"], [*TYPES, *[pa.int64()] * 3]
        for batch in batches:
            spilled = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                row, doc, _, h, _, n, least, least_row, sha, text = r
                e = table.find(h, text)
                if e < 0:
                    spilled.append((*r, None, None, None))
                    continue
                if e == len(groups):
                    groups.append([n, (least, least_row), sha])
                else:
                    groups[e][0], groups[e][1] = groups[e][0] + n, sooner(groups[e][1], (least, least_row))
                taken.append((row, doc, e))
            if spilled:
                yield records(spilled, names, types)
        for a in range(0, len(taken), 10_000):
            out = [(row, doc, row, None, None, None, None, None, groups[e][2], None, *groups[e][1], groups[e][0]) for row, doc, e in taken[a : a + 10_000]]
            yield records(out, names, types)

    return dealt.mapInArrow(run, f"{RECORD}, {SOLVED}")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, table_bytes: int = TABLE_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text); other columns go.

    Texts are one group when they are identical after each run of ASCII white space has become one space; a null text is the
    empty one. keep_id is the group's smallest doc_id, a null doc_id being larger than all; kept is true of just one row of a
    group: of repeated rows with the smallest doc_id one stays. group_size counts rows. Texts are compared whole, of any
    length: one larger than a table is alone in it. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    all_rows = scratch.save(met(docs, read_bytes))
    rest, done, level = all_rows.filter("text IS NOT NULL"), [], 0
    while (found := rest.agg(F.sum("bytes"), F.count(F.lit(1))).first())[1]:
        buckets = max(math.ceil(found[0] / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rest.select(*NAMES).repartition(buckets, F.xxhash64("h", F.lit(level)))
        out = scratch.save(solved(dealt, table_bytes))
        done.append(out.filter("text IS NULL").select("row", "doc_id", "sha", "keep_id", "keep_row", "size"))
        rest, level = out.filter("text IS NOT NULL"), level + 1
    if not done:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    leaders = reduce(DataFrame.union, done)
    copies = all_rows.filter("text IS NULL").select("row", "doc_id", "leader")
    of = leaders.select(F.col("row").alias("leader"), "sha", "keep_id", "keep_row", "size")
    every = leaders.union(copies.join(of, "leader").select("row", "doc_id", "sha", "keep_id", "keep_row", "size"))
    return every.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


OP12_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
"""
