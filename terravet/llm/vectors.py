"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Vectors are scaled to a largest norm of 1 and given one more component that makes all norms 1 (0 for queries), so that the
largest inner product is the least Euclidean distance. Each table hashes by projections on normal directions, cut into slots
of WIDTH; there are as many directions as make a bucket hold about BUCKET rows, so their number follows the rows'. A query
visits its own bucket and those that differ from it by one slot in some functions, in the order of the estimated chance of
success: by the squared distances to the slots' edges, with the sets of edges taken in the order of their expected sums. How
many are visited is measured: a bounded sample of queries is held against all rows, and the fewest visits that find RECALL of
the sample's neighbours are taken. The rows of the visited buckets are scored exactly, in double precision, and the best of
all tables are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, mix

TABLES, WIDTH, BUCKET = 2, 2.0, 2048
#: Visits in one table that are measured first, and four times as many while these are too few; share of the sample's neighbours to be found; queries in the sample.
FIRST_PROBES, RECALL, SAMPLE = 1024, 0.96, 128
#: Bits that one function tells of a row, about, at this width.
BITS = 1.3
#: Rows of a bucket that one task scores at a time; a larger bucket is dealt to several.
BLOCK = 4096


def edge_sets(functions: int, most: int) -> np.ndarray:
    """(sets, functions) places among a query's 2 * functions edges sorted by distance, -1 for none: the sets of edges to cross, in the
    order of their expected sums of squared distances. No set crosses both edges of one function, which stand at mirrored places."""
    m = functions
    j = np.arange(1, 2 * m + 1)
    square = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out, todo = [()], [(square[0], (0,))]
    while todo and len(out) < min(most, 3**m):
        cost, places = heapq.heappop(todo)
        if len({min(p, 2 * m - 1 - p) for p in places}) == len(places):
            out.append(places)
        if (last := places[-1]) + 1 < 2 * m:  # move the last edge on, or add the next
            heapq.heappush(todo, (cost - square[last] + square[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(todo, (cost + square[last + 1], (*places, last + 1)))
    return np.array([(*p, *[-1] * (m - len(p))) for p in out], np.int64).reshape(len(out), m)


class Hashes:
    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, functions))
        self.b = rng.uniform(0, width, size=(tables, 1, functions))
        self.width, self.tables, self.sets = width, tables, edge_sets(functions, probes)
        self.odd = mix(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)

    def keys(self, t: int, slots: np.ndarray) -> np.ndarray:
        return mix((slots.astype(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)

    def slots(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x @ self.a[t] + self.b[t]) / self.width
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def visits(self, t: int, q: np.ndarray) -> np.ndarray:
        """(n, probes) keys of the buckets to visit for queries, likeliest first."""
        low, part = self.slots(t, q)
        m = low.shape[1]
        near = np.argsort(np.concatenate([part, 1 - part], axis=1), axis=1, kind="stable")
        # Of the edges of one function the nearer one stands at some place and the other at the mirrored one.
        step = np.zeros((len(q), 2 * m + 1, m), np.int64)
        step[np.arange(len(q))[:, None], np.arange(2 * m)[None, :], near % m] = np.where(near < m, -1, 1)
        move = step[:, self.sets[:, 0]].copy()
        for c in range(1, m):
            move += step[:, self.sets[:, c]]
        return self.keys(t, low[:, None, :] + move)


def best(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int, near: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows, ties to smaller ids; near: scores to choose by, right but for an error."""
    other = np.flatnonzero(ids != own)
    if len(other) > k:
        edge = np.partition(near[other], len(other) - k)[len(other) - k]
        other = other[near[other] >= edge - 2 * error]
    score = (rows[other] * query).sum(axis=1)
    order = np.lexsort((ids[other], -score))[:k]
    return ids[other][order], score[order]


def scored(rows: DataFrame, dim: int, k: int, norm: float, kind: type) -> DataFrame:
    """(query_id, vec_ids, scores), the k best of each block for each of its queries.

    rows: (t, key, part, role, id, v): role 0 the rows of a block, role 1 its queries; v holds numbers of this kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, matrix = None, np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns[:5]]
            vectors = np.frombuffer(b"".join(batch.column(5).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            group = np.stack(cols[:4], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            out_q, out_v, out_s = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                key = tuple(group[a, :3].tolist())
                if key != now:
                    now, ids, matrix = key, np.zeros(0, np.int64), np.zeros((0, dim))
                if group[a, 3] == 0:
                    ids, matrix = np.concatenate([ids, cols[4][a:b]]), np.concatenate([matrix, vectors[a:b]])
                    continue
                for c in range(a, b, 256):
                    part = vectors[c : min(b, c + 256)]
                    for own, q, near in zip(cols[4][c : c + len(part)].tolist(), part, part @ matrix.T):
                        # Rounding of a sum of dim products grows with both norms.
                        found, score = best(q, ids, matrix, own, k, near, dim * 2.3e-16 * norm * float(np.sqrt((q * q).sum())))
                        out_q.append(own)
                        out_v.append(found)
                        out_s.append(score)
            if out_q:
                ends = pa.array(np.cumsum([0, *map(len, out_v)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (out_v, out_s)]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), *lists], ["query_id", "vec_ids", "scores"])

    dealt = rows.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "role")
    return dealt.mapInArrow(run, "query_id long, vec_ids array<long>, scores array<double>")


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """(id, v, n): rows with an id and a vector that isn't null, zero or holding a null or non-finite component."""
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec).isNotNull() & F.col("vec_id").isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.size(v).alias("n"))


def top(df: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what scored() found in all blocks, each vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, score = None, np.zeros(0, np.int64), np.zeros(0)

        def merged(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, first = np.unique(ids, return_index=True)
            order = first[np.lexsort((ids[first], -score[first]))][:k]
            return ids[order], score[order]

        def table(done: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            size = [len(v) for _, v, _ in done]
            cols = [np.repeat([q for q, _, _ in done], size), np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in size]), np.concatenate([v for _, v, _ in done]), np.concatenate([x for _, _, x in done])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            query, done = np.asarray(batch.column(0)), []
            cuts = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if query[a] != now:
                    if now is not None:
                        done.append((now, ids, score))
                    now, ids, score = int(query[a]), np.zeros(0, np.int64), np.zeros(0)
                own = [np.asarray(batch.column(c).slice(a, b - a).flatten()) for c in (1, 2)]
                ids, score = merged(np.concatenate([ids, own[0]]), np.concatenate([score, own[1]]))
            if done:
                yield table(done)
        if now is not None and len(ids):
            yield table([(now, ids, score)])

    return df.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def all_blocks(rows: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """rows of scored(): each of the queries (id, v) against all rows (id, v), in blocks."""
    n = -(-count // BLOCK)
    block = lambda df, part, role: df.select(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("key"), part.alias("part"), F.lit(role).alias("role"), "id", "v")
    return block(rows, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), 0).union(block(queries, F.explode(F.sequence(F.lit(0), F.lit(n - 1))), 1))


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors over the largest norm, and the component that makes their norms 1; 0 for queries."""
    scaled = x / norm
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
    return np.column_stack([scaled, rest])


def measured(rows: DataFrame, queries: DataFrame, count: int, k: int, dim: int, norm: float, kind: type, hashes: Callable[[int], Hashes]) -> int:
    """The fewest visits in each table that find RECALL of the k nearest of a sample of at most 2 * SAMPLE queries: of FIRST_PROBES, then of four
    times as many, and so on until they do, or until every bucket that there may be is visited. hashes: from a number of visits."""
    n = queries.count()
    sample = queries.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(max(1, n))) < SAMPLE).orderBy("id").limit(2 * SAMPLE)
    asked = {r["id"]: np.frombuffer(r["v"], kind) for r in sample.collect()}
    if not asked:
        return 1
    sample = sample.sparkSession.createDataFrame([(i, bytearray(v.tobytes())) for i, v in asked.items()], "id long, v binary")
    exact = top(scored(all_blocks(rows, F.broadcast(sample), count), dim, k, norm, kind), k)
    found = exact.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", "v").collect()
    q = lifted(np.array([asked[r["query_id"]] for r in found], np.float64), norm, True)
    x = lifted(np.array([np.frombuffer(r["v"], kind) for r in found], np.float64), norm, False)
    most = FIRST_PROBES
    while True:
        made = hashes(most)
        need, step = np.full(len(found), len(made.sets)), max(1, (1 << 16) // len(made.sets))
        for t in range(made.tables):
            for at in range(0, len(found), step):
                keys = made.keys(t, made.slots(t, x[at : at + step])[0])
                hit = made.visits(t, q[at : at + step]) == keys[:, None]
                need[at : at + step] = np.minimum(need[at : at + step], np.where(hit.any(axis=1), hit.argmax(axis=1), len(made.sets)))
        fewest = int(np.sort(need)[min(len(need) - 1, math.ceil(RECALL * len(need)))]) + 1
        if fewest <= len(made.sets) or len(made.sets) < most:
            return min(len(made.sets), fewest)
        most *= 4


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec: str = "embedding", tables: int = TABLES, functions: int | None = None, width: float = WIDTH, probes: int | None = None) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k rows found nearest to each query row of vectors (vec_id, `vec`), other columns go.

    is_query: a condition on vec_id. Candidates are all rows but those with the query's own vec_id; vec_id is a key, and
    repeated rows count once. The score is the inner product in double precision; ties go to the smaller vec_id. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do those whose length isn't the commonest
    one, as no product with them is defined. functions and probes are set by the rows and a measured sample unless given.
    A query that visits fewer than k rows, where there are more, is scored against all rows, in blocks.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.float32 if isinstance(vectors.schema[vec].dataType.elementType, FloatType) else np.float64
    rows = usable(vectors, vec)
    shape = rows.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).orderBy(F.desc("c"), F.desc("n")).first()
    if shape is None:
        return empty
    dim, count, norm = int(shape["n"]), int(shape["c"]), float(shape["norm"]) ** 0.5
    rows = rows.filter(F.col("n") == dim).withColumnRenamed("id", "vec_id").withColumn("q", F.coalesce(is_query, F.lit(False))).withColumnRenamed("vec_id", "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["id", "v", "q"])

    with scratch.inner() as own:
        rows = own.save(rows.select("id", "v", "q").mapInArrow(packed, "id long, v binary, q boolean"))
        queries = rows.filter("q").select("id", "v").dropDuplicates(["id"])
        if functions is None:
            functions = min(24, max(2, round(math.log2(max(2.0, count / BUCKET)) / BITS)))
        if probes is None:
            probes = measured(rows.select("id", "v"), queries, count, k, dim, norm, kind, lambda most: Hashes(dim, tables, functions, width, most))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Hashes(dim, tables, functions, width, probes)
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    ids, raw, ask = part.column(0), part.column(1), np.asarray(part.column(2).to_pylist(), bool)
                    x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                    for t in range(tables):
                        keys, who, role = made.keys(t, made.slots(t, lifted(x, norm, False))[0]), np.arange(len(x)), np.zeros(len(x), np.int32)
                        if ask.any():
                            visited = made.visits(t, lifted(x[ask], norm, True))
                            keys, who = np.concatenate([keys, visited.ravel()]), np.concatenate([who, np.repeat(np.flatnonzero(ask), visited.shape[1])])
                            role = np.concatenate([role, np.ones(visited.size, np.int32)])
                        take = pa.array(who)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(role), ids.take(take)], ["t", "key", "role", "id"])

        hashed = own.save(rows.mapInArrow(placed, "t int, key long, role int, id long"))
        sizes = hashed.filter("role = 0").groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("parts"))
        known = hashed.join(sizes, ["t", "key"])
        data = known.filter("role = 0").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # Of buckets only those that hold rows are visited, and a vector is joined to its visits at the end.
        asked = known.filter("role = 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        order = ["t", "key", "part", "role", "id"]
        visits = own.save(data.select(order).union(asked.select(order)))
        blocks = visits.join(rows.select("id", "v").dropDuplicates(["id"]), "id").select(*order, "v")
        found = own.save(scored(blocks, dim, k, norm, kind))
        first = scratch.save(top(found, k))
        reached = first.groupBy("query_id").agg(F.max("rank").alias("n"))
        ids = queries.select("id").join(reached, F.col("id") == F.col("query_id"), "left")
        poor = own.save(ids.filter(F.coalesce("n", F.lit(0)) < min(k, count - 1)).select("id"))
        if poor.isEmpty():
            return first
        again = all_blocks(rows.select("id", "v"), queries.join(poor, "id", "left_semi"), count)
        second = scratch.save(top(scored(again, dim, k, norm, kind), k))
        left = scratch.save(first.join(poor.withColumnRenamed("id", "query_id"), "query_id", "left_anti"))
    return left.union(second)
