"""Vector code compression: product codes whose codebooks are learned by Lloyd's rounds over pairs of trees, in whole numbers.

Components become floor(scale * x), so all sums and distances are exact. Vectors are dealt in blocks of BLOCK rows; each part of
a block's vectors gets a tree of boxes, split at the middle of the widest side down to LEAF points, with the sum of each node's
points. The trees are written once and read by every round. A round carries the codebooks, which are as small as their
parameters say, to the tasks, where each codebook is a tree of boxes too. Pairs of nodes are followed from both roots down: a
pair goes when its least distance is over another's greatest, or when one entry is nearer than another all over a box. A node
left with one entry is assigned whole by its sum; only leaves that keep several compare their points with them, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

#: Rows of a block and the most points of a leaf.
BLOCK, LEAF = 1024, 16


def square(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


class Forest:
    """The trees of one block, one for each part; level l has parts x 2^l nodes, node j of it the points from j * n >> l on."""

    def __init__(self, n: int, points: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.n, self.points, self.order, self.lo, self.hi, self.sums = n, points, order, lo, hi, sums
        self.parts = len(order)
        self.depth = depth(n)

    def cuts(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * self.n) >> level

    def first(self, level: int) -> int:
        """Where the nodes of a level begin in lo, hi and sums."""
        return self.parts * ((1 << level) - 1)

    def starts(self, level: int) -> np.ndarray:
        """The place in points, part after part, of each node's first point."""
        return (np.arange(self.parts)[:, None] * self.n + self.cuts(level)[None, :-1]).ravel()

    def sizes(self, level: int) -> np.ndarray:
        return np.tile(np.diff(self.cuts(level)), self.parts)


def depth(n: int) -> int:
    """Levels below the root, so that no leaf has more than LEAF points and none is empty."""
    d = 0
    while (n + (1 << d) - 1) >> d > LEAF:
        d += 1
    return d


def planted(vectors: np.ndarray, parts: int) -> Forest:
    """Trees over the parts of whole-number vectors (n, parts * width)."""
    n, width = len(vectors), vectors.shape[1] // parts
    points = vectors.reshape(n, parts, width).transpose(1, 0, 2).reshape(parts * n, width)
    order = np.tile(np.arange(n, dtype=np.int32), parts)
    out = Forest(n, points, order.reshape(parts, n), *(np.zeros((0, width), np.int64),) * 3)
    boxes = []
    for level in range(out.depth + 1):
        at = out.starts(level)
        lo, hi = np.minimum.reduceat(points, at, axis=0), np.maximum.reduceat(points, at, axis=0)
        boxes.append((lo, hi, np.add.reduceat(points, at, axis=0)))
        if level < out.depth:
            node = np.repeat(np.arange(len(at)), out.sizes(level))
            by = points[np.arange(len(points)), (hi - lo).argmax(axis=1)[node]]
            moved = np.lexsort((by, node))
            points, order = points[moved], order[moved]
    out.points, out.order = points, order.reshape(parts, n)
    out.lo, out.hi, out.sums = (np.concatenate(x) for x in zip(*boxes))
    return out


class EntryTrees:
    """Boxes over each part's entries: node i has left and right children, or is the leaf of one entry (then both are -1)."""

    def __init__(self, books: list[np.ndarray]):
        self.books, lo, hi, left, right, entry, part = books, [], [], [], [], [], []
        self.roots = []

        def grow(p: int, own: np.ndarray) -> int:
            at, some = len(lo), books[p][own]
            lo.append(some.min(axis=0)), hi.append(some.max(axis=0))
            left.append(-1), right.append(-1), entry.append(int(own[0])), part.append(p)
            if len(own) > 1:
                side = (hi[at] - lo[at]).argmax()
                own = own[np.argsort(some[:, side], kind="stable")]
                left[at], right[at] = grow(p, own[: len(own) // 2]), grow(p, own[len(own) // 2 :])
            return at

        for p, book in enumerate(books):
            self.roots.append(grow(p, np.arange(len(book))))
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.left, self.right, self.entry, self.part = (np.array(x, np.int64) for x in (left, right, entry, part))
        self.leaf = self.left < 0


def groups(node: np.ndarray) -> np.ndarray:
    """Where each run of equal nodes begins."""
    return np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))


def pruned(forest: Forest, level: int, trees: EntryTrees, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (data node, entry node), sorted by data node, that may hold a point's nearest entry."""
    base = forest.first(level)
    dlo, dhi, elo, ehi = forest.lo[base + node], forest.hi[base + node], trees.lo[at], trees.hi[at]
    least = square(np.maximum(np.maximum(elo - dhi, dlo - ehi), 0))
    most = square(np.maximum(dhi - elo, ehi - dlo))
    begin = groups(node)
    runs = np.diff(np.append(begin, len(node)))
    keep = least <= np.repeat(np.minimum.reduceat(most, begin), runs)
    # Against the entry node of least greatest distance, if it is a leaf: |x - b|^2 - |x - a|^2 is linear in x, so its least value stands at a corner.
    rank = np.lexsort((trees.entry[at], most, node))[begin]
    a = np.repeat(rank, runs)
    both = keep & trees.leaf[at] & trees.leaf[at[a]] & (a != np.arange(len(a)))
    x = np.flatnonzero(both)
    if len(x):
        near, far = elo[a[x]], elo[x]
        step = far - near
        gap = square(far) - square(near) - 2 * np.where(step > 0, step * dhi[x], step * dlo[x]).sum(axis=1)
        keep[x[(gap > 0) | (gap == 0) & (trees.entry[at[a[x]]] < trees.entry[at[x]])]] = False
    return node[keep], at[keep]


def children(trees: EntryTrees, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the entry nodes' children, and with leaves as they are; sorted by node, then entry."""
    leaf = trees.leaf[at]
    node, at = np.concatenate([node[leaf], node[~leaf], node[~leaf]]), np.concatenate([at[leaf], trees.left[at[~leaf]], trees.right[at[~leaf]]])
    order = np.lexsort((trees.entry[at], node))
    return node[order], at[order]


def assigned(forest: Forest, trees: EntryTrees, whole: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point (places of forest.points); and, for each part and entry, the sums and the number of its points.

    whole: gets (nodes assigned whole, points compared) if given.
    """
    width = forest.points.shape[1]
    counts = [len(b) for b in trees.books]
    offset = np.concatenate([[0], np.cumsum(counts)])
    totals = np.zeros((offset[-1], width + 1), np.int64)
    nearest = np.zeros(len(forest.points), np.int64)
    node, at = np.arange(forest.parts), np.array(trees.roots)
    n_whole = n_points = 0
    for level in range(forest.depth + 1):
        last = level == forest.depth
        while True:
            node, at = pruned(forest, level, trees, node, at)
            if not len(node) or not last or trees.leaf[at].all():
                break
            node, at = children(trees, node, at)
        if not len(node):
            break
        begin = groups(node)
        runs = np.diff(np.append(begin, len(node)))
        one = begin[(runs == 1) & trees.leaf[at[begin]]]
        starts, sizes, base = forest.starts(level), forest.sizes(level), forest.first(level)
        if len(one):
            slot = offset[trees.part[at[one]]] + trees.entry[at[one]]
            np.add.at(totals, slot, np.column_stack([forest.sums[base + node[one]], sizes[node[one]]]))
            nearest[spans(starts[node[one]], sizes[node[one]])] = np.repeat(trees.entry[at[one]], sizes[node[one]])
            n_whole += len(one)
            rest = np.ones(len(node), bool)
            rest[one] = False
            node, at = node[rest], at[rest]
        if not len(node):
            break
        if last:
            n_points += compared(forest, trees, starts, sizes, node, at, nearest, totals, offset)
        else:
            node, at = split(trees, node, at)
    if whole is not None:
        whole.append((n_whole, n_points))
    return nearest, totals


def split(trees: EntryTrees, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of both children of the data nodes with the children of the entry nodes."""
    node, at = children(trees, node, at)
    node, at = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([at, at])
    order = np.lexsort((trees.entry[at], node))
    return node[order], at[order]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at `starts`."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def compared(forest: Forest, trees: EntryTrees, starts: np.ndarray, sizes: np.ndarray, node: np.ndarray, at: np.ndarray, nearest: np.ndarray, totals: np.ndarray, offset: np.ndarray) -> int:
    """Assign the points of leaves that keep several entries, the entries of a leaf in their order, so that ties go to the lower."""
    begin = groups(node)
    runs = np.diff(np.append(begin, len(node)))
    size = sizes[node[begin]]
    place = spans(starts[node[begin]], size)
    owner = np.repeat(np.arange(len(begin)), size)
    best, chosen = np.full(len(place), np.iinfo(np.int64).max), np.zeros(len(place), np.int64)
    for k in range(int(runs.max())):
        has = runs[owner] > k
        own = at[begin[owner[has]] + k]
        d = square(forest.points[place[has]] - trees.lo[own])
        nearer = d < best[has]
        x = np.flatnonzero(has)[nearer]
        best[x], chosen[x] = d[nearer], own[nearer]
    nearest[place] = trees.entry[chosen]
    np.add.at(totals, offset[trees.part[chosen]] + trees.entry[chosen], np.column_stack([forest.points[place], np.ones(len(place), np.int64)]))
    return len(place)


def numbers(column: pa.Array) -> list[np.ndarray]:
    """Each row of a list array as numbers."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, whole array<long>) of the rows whose vector is there and has finite components only."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & ~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("whole"))


def smallest(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the n smallest ids, ascending, a missing id last; of rows with one id the least vector. Each step asks for n rows."""
    found: list = []
    rest = rows
    while len(found) < n:
        some = rest.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(n - len(found)).collect()
        for r in some:
            if not found or found[-1][0] != r["vec_id"]:
                found.append((r["vec_id"], list(r["whole"])))
        if not some or some[-1]["vec_id"] is None:
            break
        rest = rows.filter((F.col("vec_id") > some[-1]["vec_id"]) | F.col("vec_id").isNull())
    return [w for _, w in found]


def rooted(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """One row for each block: its ids and labels, and the trees of all parts."""
    kind = rows.schema["label"].dataType
    limit = int((2**61 / max(width, 1)) ** 0.5) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                whole = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, parts * width)
                if whole.size and (whole.max() > limit or whole.min() < -limit):
                    raise ValueError(f"components beyond {limit} in whole numbers")
                f = planted(whole, parts)
                one = lambda x, t: pa.array([np.ravel(x)], pa.list_(t))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in (part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [*lists, one(f.order, pa.int32()), *[one(x, pa.int64()) for x in (f.points, f.lo, f.hi, f.sums)]], ["ids", "labels", "order", "points", "lo", "hi", "sums"]
                )

    return rows.mapInArrow(run, f"ids array<long>, labels array<{kind.simpleString()}>, order array<int>, points array<long>, lo array<long>, hi array<long>, sums array<long>")


def forests(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[int, Forest]]:
    for i, cols in enumerate(zip(*[numbers(batch.column(batch.schema.get_field_index(c))) for c in ("order", "points", "lo", "hi", "sums")])):
        order = cols[0].reshape(parts, -1)
        yield i, Forest(order.shape[1], cols[1].reshape(-1, width), order, *[c.reshape(-1, width) for c in cols[2:]])


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the floor of its points' mean, unused entries as they were."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, totals = EntryTrees(books), None
        for batch in batches:
            for _, f in forests(batch, parts, width):
                own = assigned(f, trees)[1]
                totals = own if totals is None else totals + own
        if totals is not None:
            part = np.repeat(np.arange(parts), [len(b) for b in books]).astype(np.int32)
            entry = np.concatenate([np.arange(len(b)) for b in books]).astype(np.int32)
            used = totals[:, -1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(part[used]), pa.array(entry[used]), pa.array(totals[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "totals"])

    sums = blocks.select("order", "points", "lo", "hi", "sums").mapInArrow(run, "part int, entry int, totals array<long>")
    each = [F.sum(F.col("totals")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(width + 1)]
    out = [b.copy() for b in books]
    for p, e, *t in sums.groupBy("part", "entry").agg(*each).collect():  # parts x entries rows at most
        out[p][e] = [int(x) // int(t[-1]) for x in t[:-1]]
    return out


def product_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error long) of each row of vectors (vec_id, embedding, label) that takes part; and each part's codebook.

    Vectors that are null or hold a null or non-finite component take no part, nor do those of another length than that of the
    smallest vec_id. Components become floor(scale * x); vectors are cut in `parts` equal parts, and a length that doesn't allow it raises
    ValueError, as do components whose squared distances need more than 62 bits. A codebook begins with that part of the
    vectors of the `entries` smallest distinct ids (fewer, if there are fewer; a null id counts as the last; of rows with one id
    the least vector). Each round assigns every part to its nearest entry, ties to the lower index, and moves each used entry to
    the floor of its parts' mean. codes are the indexes of the nearest entries in the last codebooks, error the sum of their
    squared distances. Repeated rows each count and each get their row; columns other than these three are left out. A table
    without rows that take part gives no rows and no codebooks.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    kind = vectors.schema["label"].dataType.simpleString()
    made = f"vec_id long, label {kind}, codes array<int>, error long"
    rows = whole_numbers(vectors, scale)
    first = smallest(rows, 1)
    if not first:
        return vectors.sparkSession.createDataFrame([], made), []
    length = len(first[0])
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components can't be cut in {parts} equal parts")
    rows, width = rows.filter(F.size("whole") == length), length // parts
    seeds = np.array(smallest(rows, entries), np.int64).reshape(-1, parts, width)
    books = [seeds[:, p].copy() for p in range(parts)]
    blocks = scratch.save(rooted(rows, parts, width))
    for _ in range(rounds):
        books = moved(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = EntryTrees(books)
        for batch in batches:
            for i, f in forests(batch, parts, width):
                nearest = assigned(f, trees)[0].reshape(parts, f.n)
                codes, error = np.zeros((f.n, parts), np.int32), np.zeros(f.n, np.int64)
                for p in range(parts):
                    codes[f.order[p], p] = nearest[p]
                    error[f.order[p]] += square(f.points[p * f.n : (p + 1) * f.n] - books[p][nearest[p]])
                at = pa.array(np.arange(f.n + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.ListArray.from_arrays(at, pa.array(codes.ravel())), pa.array(error)], ["vec_id", "label", "codes", "error"]
                )

    return scratch.save(blocks.mapInArrow(run, made)), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over the rows of the same label, null being one label; codes is a saved table, of which labels are summed before they are joined back."""
    sums = Scratch(codes.sparkSession, "label-errors").save(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    side = small(sums.withColumnRenamed("label", "of"), F.lit(64) + F.coalesce(F.length(F.col("of").cast("string")), F.lit(0)))
    return codes.join(side, codes["label"].eqNullSafe(side["of"]), "left").drop("of")


def text_of(books: list[np.ndarray]) -> str:
    """All entries' components as decimal numbers, by part, entry and position."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def statement(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The query in DuckDB SQL, a pair of common tables for each round."""
    nearest = """a{i} AS MATERIALIZED (SELECT r, p.part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT r, p.part, b.entry, list_sum(list_transform(list_zip(p.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN b{i} b ON p.part = b.part) p GROUP BY r, p.part)"""
    step = """s{i} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM a{i} a JOIN parts p ON a.r = p.r AND a.part = p.part) GROUP BY 1, 2, 3),
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS w FROM s{i} GROUP BY 1, 2),
b{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)"""
    rest = ",\n".join(f"{nearest.format(i=i)},\n{step.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, part, w[part * (len(w) // {parts}) + 1 : (part + 1) * (len(w) // {parts})] AS w FROM kept, (SELECT unnest(range({parts})) AS part)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w) AS k FROM kept) WHERE k = 1),
b0 AS MATERIALIZED (SELECT part, entry, w FROM seeds JOIN parts USING (r) WHERE entry < {entries}),
{rest},
{nearest.format(i=rounds)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""
