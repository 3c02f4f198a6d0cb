"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece goes on after a white-space marker and none holds a line feed with other characters, merges never cross
the cuts before a run of markers and around line feeds. tokenize_joined builds one table of the distinct chunks of all documents,
segments each once with the library, and joins the ids back by position. tokenize does the same within each task, for models
that can't be cut and for few documents: its table is dropped and begun again at TABLE_CHUNKS entries.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

TABLE_CHUNKS = 300_000
#: Characters of a block of texts that share numbers of chunks.
BLOCK_BYTES = 32 << 20
#: Parts of the table of chunks for each shuffle partition.
SPREAD = 4
MARK = "▁"
CUT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Segmenter:
    """encode() and decode() of one model; equal to the library's own."""

    def __init__(self, model: str, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.sp, self.most = sentencepiece.SentencePieceProcessor(model_file=model), table_chunks
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not self.sp.is_byte(i)]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)
        plain = self.sp.normalize("a  b\nc ") == f"{MARK}a{MARK}{MARK}b\nc{MARK}"
        first = self.sp.encode("\n", out_type=str)
        self.cuts = not crossing and plain and first == [MARK, "<0x0A>"]
        self.table: dict[str, list[int]] = {}
        self.start()

    def start(self) -> None:
        self.table.clear()
        if self.cuts:
            mark, feed = self.sp.encode("\n")
            self.table.update({MARK: [mark], "\n": [feed]})

    def learn(self, chunks: set[str]) -> None:
        """The library puts a marker before what it encodes: a chunk's first marker is left to it, and a chunk without one follows a line feed."""
        marked = [c for c in chunks if c[0] == MARK]
        bare = [c for c in chunks if c[0] != MARK]
        self.table.update(zip(marked, self.sp.encode([c[1:] for c in marked], num_threads=1)))
        self.table.update((c, ids[2:]) for c, ids in zip(bare, self.sp.encode(["\n" + c for c in bare], num_threads=1)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.cuts:
            return self.sp.encode(texts, num_threads=1)
        cut = [CUT.findall(self.sp.normalize(t)) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.table)
        if len(self.table) + len(new) > self.most:
            self.start()
            new = set(chain.from_iterable(cut)).difference(self.table)
        if new:
            self.learn(new)
        get = self.table.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.sp.decode(x) if x else "" for x in ids]


def tokenize(df: DataFrame, model: str, keep: str = "doc_id", text: str = "text", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """`keep`, n_tokens long, ids array<int>, decoded string of every row; other columns of df go.

    model: path of the model, the same on every machine. Whole texts without begin or end ids; a null text is the empty
    one and has no ids. Repeated rows and texts of any length are encoded like others; an empty table gives an empty one.
    """
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(model, table_chunks)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = seg.encode([t or "" for t in part.column(1).to_pylist()])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(seg.decode(ids), pa.string())],
                    ["keep", "n_tokens", "ids", "decoded"],
                )

    out = df.select(F.col(keep).alias("keep"), F.col(text).alias("text")).mapInArrow(run, f"keep {kind}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("keep", keep)


@cache
def segmenter(model: str) -> Segmenter:
    """One for each model of a worker, for what is called once a block."""
    return Segmenter(model)


def zipped(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unzipped(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, their lowest bytes first, then the next ones, as these are alike."""
    return zipped(np.asarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzipped(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs of these sizes that begin at `starts`."""
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - sizes), sizes)


class BlockTable:
    """Ids of a block's chunks by their numbers; a part's rising numbers come as their steps."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        parts = [(np.cumsum(unpacked(steps), dtype=np.int64), unpacked(sizes), unpacked(ids)) for steps, sizes, ids in rows]
        sizes = np.zeros(sum(len(n) for n, _, _ in parts), np.int64)
        for numbers, size, _ in parts:
            sizes[numbers] = size
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flat = np.zeros(self.ends[-1], np.int32)
        for numbers, size, ids in parts:
            self.flat[runs(self.ends[numbers], size.astype(np.int64))] = ids

    def of(self, numbers: np.ndarray) -> np.ndarray:
        n = numbers.astype(np.int64)
        return self.flat[runs(self.ends[n], self.ends[n + 1] - self.ends[n])]


def tokenize_joined(df: DataFrame, model: str, keep: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same rows as tokenize, by one table of the distinct chunks of all documents, each segmented once, joined back by position.

    Texts are cut in blocks of `block_bytes`; a block keeps each text as numbers and sends each of its distinct chunks once,
    packed by parts of a hash of the chunk. A part's task has all of its chunks' senders, segments each chunk once, and sends
    the ids back to the blocks, where numbers lead to them. So what is dealt are distinct chunks of blocks and never words:
    texts lie in a table in buckets of blocks, to which only ids are shuffled; a task holds the chunks of one part or of one block. Nulls, empty and long texts and repeated rows are as in
    tokenize. A model whose pieces may cross the cuts raises ValueError.
    """
    if not Segmenter(model).cuts:
        raise ValueError("pieces of this model may cross white-space markers")
    kind, scratch = df.schema[keep].dataType.simpleString(), Scratch(df.sparkSession, "pieces")
    parts = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, block, numbers, size = Segmenter(model), TaskContext.get().partitionId() << 32, {}, 0
        names = ["block", "keep", "positions", "part", "numbers", "chunks"]

        def sent(kept_type: pa.DataType) -> pa.RecordBatch:
            own = [c.encode() for c in numbers]
            part = np.array([zlib.crc32(c) % parts for c in own], np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
            each = [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            n = len(each)
            # A line feed is a chunk of its own and is in no other: it stands as the empty one.
            lists = [zipped(b"\n".join(b"" if own[i] == b"\n" else own[i] for i in e.tolist())) for e in each]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.nulls(n, kept_type), pa.nulls(n, pa.binary()), pa.array(part[order][cuts[:-1]]), pa.array([packed(np.diff(e, prepend=0)) for e in each], pa.binary()), pa.array(lists, pa.binary())], names
            )

        kept_type = None
        for batch in batches:
            kept_type = batch.column(0).type
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                add, n = numbers.setdefault, len(texts)
                positions = [packed([add(c, len(numbers)) for c in CUT.findall(seg.sp.normalize(t))]) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), part.column(0), pa.array(positions, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
                size += sum(map(len, texts))
                if size >= block_bytes:
                    if numbers:
                        yield sent(kept_type)
                    block, size = block + 1, 0
                    numbers.clear()
        if numbers:
            yield sent(kept_type)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, whose table is dropped when the next one begins."""
        seg, now = Segmenter(model), None
        for batch in batches:
            sizes, ids = [], []
            for part, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if part != now:
                    now = part
                    seg.start()
                chunks = [c or "\n" for c in unzipped(data).decode().split("\n")]
                new = set(chunks).difference(seg.table)
                if new:
                    seg.learn(new)
                found = [seg.table[c] for c in chunks]
                sizes.append(packed(list(map(len, found))))
                ids.append(packed(list(chain.from_iterable(found))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "numbers", "sizes", "ids"])

    def place(known: pa.Table, texts: pa.Table) -> pa.Table:
        """All of one block: its chunks' ids, and its texts as numbers."""
        seg = segmenter(model)
        table = BlockTable(list(zip(*[known.column(c).to_pylist() for c in ("numbers", "sizes", "ids")])))
        out = []
        for batch in texts.select(["keep", "positions"]).to_batches():
            for x, y in slices(batch.column(1)):
                some = batch.slice(x, y - x)
                ids = [table.of(unpacked(data)) for data in some.column(1).to_pylist()]
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                out.append(pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), lists, pa.array(seg.decode([i.tolist() for i in ids]), pa.string())], ["keep", "n_tokens", "ids", "decoded"]))
        none = {"keep": texts.schema.field("keep").type, "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
        return pa.Table.from_batches(out) if out else pa.schema(none).empty_table()

    rows = df.select(F.col(keep).alias("keep"), F.col(text).alias("text")).mapInArrow(cut, f"block long, keep {kind}, positions binary, part int, numbers binary, chunks binary")
    rows = scratch.save_dealt(rows, "block", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.filter("part IS NOT NULL").select("block", "part", "numbers", "chunks")
    known = asked.repartition("part").sortWithinPartitions("part").mapInArrow(learn, "block long, numbers binary, sizes binary, ids binary")
    texts = rows.filter("positions IS NOT NULL").select("block", "keep", "positions")
    out = known.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(place, f"keep {kind}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("keep", keep)
