"""Near duplicates: circulant MinHash, banding, exact Jaccard verification, components.

Two permutations make every coordinate of a signature: sigma scatters a set's elements over the positions of a circle,
pi ranks the positions, and coordinate k is the least rank met when pi is shifted by k. Items that share a band are
candidates. In each band's bucket all are first compared with one pivot; that joins a large group of copies in as many
comparisons as it has members. Buckets that still hold several components then have the pairs across components
compared, in blocks, on signatures, and those that may reach the threshold on the full sets. So no link between items of
one bucket is lost, and copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, encoded, joined, mix, prefix_sums, slices, stretch_hashes, words
from .graph import components

#: Members compared with one copy of a pivot, and elements at a time.
STAR, COLUMNS = 64, 2048
#: Members up to whose square pairs are compared one by one.
FEW = 8
#: Members and bytes of a block that is held, when the rest of a group is compared, and bytes that pass it in one task.
BLOCK, BLOCK_BYTES, PASS_BYTES = 1024, 16 << 20, 64 << 20

Sets = Callable[[list[bytes]], list[np.ndarray]]


class Circulant:
    """Signatures of sets of 64-bit elements, of `bands` x `rows` coordinates over a circle of 2^bits positions."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k, self.shift = bands, rows, bands * rows, np.uint64(64 - bits)
        kind = np.uint16 if bits <= 16 else np.uint32
        self.sigma = np.uint64(int(rng.integers(1, 1 << 62)) * 4 + 1)
        pi = rng.permutation(1 << bits).astype(kind)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.k]]), self.k)
        self.factors = rng.integers(1, 1 << 62, self.k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def places(self, elements: np.ndarray) -> np.ndarray:
        """sigma multiplies by an odd number modulo 2^64, a permutation of the elements; the top bits are the place."""
        return (elements * self.sigma >> self.shift).astype(np.int64)

    def least(self, places: np.ndarray) -> np.ndarray:
        """The signature of one set, whose elements stand at these places."""
        out = np.minimum.reduce(self.shifted[places[:4096]], axis=0)
        for at in range(4096, len(places), 4096):
            np.minimum(out, np.minimum.reduce(self.shifted[places[at : at + 4096]], axis=0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(n, bands) 64-bit keys of the bands of (n, k) signatures."""
        sums = ((signatures.astype(np.uint64) + np.uint64(1)) * self.factors).reshape(len(signatures), self.bands, self.rows).sum(axis=2, dtype=np.uint64)
        return mix(sums ^ self.names).view(np.int64)


def word_sets(n: int) -> Sets:
    """Sets of n-word shingles as sorted 64-bit hashes: small A-Z, words of bytes that aren't ASCII white space. With fewer words the whole sequence is one shingle; without words the set is empty."""

    def of(texts: list[bytes]) -> list[np.ndarray]:
        data, _, ends = joined(texts)
        data = LOWER[data]
        s, e = words(data)
        h = stretch_hashes(prefix_sums(data), s, e)
        bounds = np.searchsorted(s, np.concatenate([[0], ends]))
        odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        m = max(0, len(h) - n + 1)
        grams = mix(sum((h[j : m + j] * odd[j] for j in range(n)), np.zeros(m, np.uint64)))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                out.append(unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(mix((h[a:b] * odd[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    return of


def byte_sets(n: int = 8) -> Sets:
    """Sets of all stretches of 8 bytes with small A-Z, sorted; a shorter text is one stretch, padded."""
    assert n == 8

    def of(texts: list[bytes]) -> list[np.ndarray]:
        return [unique(np.ndarray((max(1, len(t) - 7),), "<u8", t.lower().ljust(8, b"\0"), 0, (1,))) for t in texts]

    return of


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den, compared in whole numbers."""

    num: int
    den: int

    def may(self, a: int, b: int) -> bool:
        """Whether sets of these sizes can reach it."""
        return bool(a and b) and self.den * min(a, b) >= self.num * max(a, b)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        return self.may(len(a), len(b)) and bool(self.met(shared(a, b), len(a), len(b)))

    def met(self, both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
        """Whether sets of sizes a and b, of which so many elements are in both, reach it; empty sets don't."""
        return (both > 0) & (self.den * both >= self.num * (a + b - both))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows with equal first `keys` columns, from sorted batches."""
    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        key = list(zip(*cols[:keys]))
        cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = [c[a:b] for c in cols]
            if held is not None and all(h[-1] == p[0] for h, p in zip(held[:keys], part[:keys])):
                for h, p in zip(held, part):
                    h.extend(p)
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct elements, sorted; for the many small sets faster than numpy's own."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sets have in common."""
    x = np.concatenate((a, b))
    x.sort()
    return int(np.count_nonzero(x[1:] == x[:-1]))


def verify(pairs: DataFrame, texts: DataFrame, sets: Sets, threshold: Threshold, scratch: Scratch) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold. texts: (id, text) that holds all their ids, once.

    Each b with up to STAR of its partners, by a hash, forms one group, so that a b of many partners is spread.
    """
    kind = texts.schema["id"].dataType.simpleString()
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(STAR))).cast("int").alias("groups"))
    dealt = scratch.save(pairs.join(counts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("groups"))))
    pivots = dealt.select("b", "part").distinct().select("b", "part", F.lit(0).alias("role"), F.col("b").alias("id"))
    members = dealt.select("b", "part", F.lit(1).alias("role"), F.col("a").alias("id"))
    rows = pivots.union(members).join(texts, "id").select("b", "part", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            role, hit = np.asarray(batch.column(2)), np.zeros(batch.num_rows, bool)
            for x, y in slices(batch.column(4)):
                found = sets(encoded(batch.column(4).slice(x, y - x)))
                for i, own in enumerate(found, x):  # rows come sorted, each group's pivot before its members
                    if role[i] == 0:
                        pivot = own
                    else:
                        hit[i] = threshold.links(pivot, own)
            if hit.any():
                mask = pa.array(hit)
                yield pa.RecordBatch.from_arrays([batch.column(3).filter(mask), batch.column(0).filter(mask)], ["a", "b"])

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(run, f"a {kind}, b {kind}")


class Labels:
    """Union-find of the labels that one task meets."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x: object) -> object:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def merge(self, a: object, b: object) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def products(held: list[np.ndarray], met: list[np.ndarray]) -> np.ndarray:
    """(held, met) sizes of the intersections, from products of the incidence of the elements that both sides hold."""
    both = np.zeros((len(held), len(met)), np.float32)
    sizes = [len(x) for x in (*held, *met)]
    if not held or not met or not sum(sizes):
        return both
    element, at = np.unique(np.concatenate([*held, *met]), return_inverse=True)
    cut = sum(sizes[: len(held)])
    left, right = np.bincount(at[:cut], minlength=len(element)) > 0, np.bincount(at[cut:], minlength=len(element)) > 0
    keep = left & right
    column, owner = (np.cumsum(keep) - 1)[at], np.repeat(np.arange(len(sizes)), sizes)
    column, owner = column[keep[at]], owner[keep[at]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(keep.sum()), COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        some = np.zeros((len(sizes), COLUMNS), np.float32)
        some[owner[x:y], column[x:y] - first] = 1
        both += some[: len(held)] @ some[len(held) :].T
    return both


def joining(held: list[np.ndarray], own: list, met: list[np.ndarray], other: list, labels: Labels, threshold: Threshold) -> list[tuple[int, int]]:
    """Places in held and met whose sets reach the threshold, as many as join their labels own and other."""
    out = []
    if len(held) * len(met) <= FEW * FEW:
        for i, x in enumerate(held):
            for j, y in enumerate(met):
                if labels.find(own[i]) != labels.find(other[j]) and threshold.links(x, y):
                    labels.merge(own[i], other[j])
                    out.append((i, j))
        return out
    both, codes = products(held, met), {}
    n, m = np.array([len(x) for x in held], np.int64), np.array([len(x) for x in met], np.int64)
    code = np.array([codes.setdefault(x, len(codes)) for x in other])
    for i, x in enumerate(own):
        hits = np.flatnonzero(threshold.met(both[i], n[i], m))
        _, first = np.unique(code[hits], return_index=True)
        out += [(i, j) for j in hits[first].tolist() if labels.merge(x, other[j])]
    return out


def across(members: DataFrame, texts: DataFrame, sets: Sets, threshold: Threshold, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members (key, id, component) of one group but different components, as many as join them.

    Of two different components one isn't the group's commonest, so only the members of other components are held against
    all: they are dealt in blocks (i) bounded by number and bytes, and what passes each block is dealt in parts (j).
    texts: (id, text) of all members, an id once.
    """
    kind = texts.schema["id"].dataType.simpleString()
    usual = members.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("usual"))
    sized = members.join(usual, "key").join(texts.select("id", F.octet_length("text").alias("bytes")), "id")
    sized = scratch.save(sized.select("key", "id", F.col("component").alias("label"), "bytes", (F.col("component") != F.col("usual")).alias("odd")))
    odd = lambda c: F.sum(F.when(F.col("odd"), c).otherwise(0))
    blocks = F.greatest(F.ceil(odd(F.lit(1)) / F.lit(float(BLOCK))), F.ceil(odd(F.col("bytes")) / F.lit(float(BLOCK_BYTES)))).cast("int")
    deal = sized.groupBy("key").agg(blocks.alias("ni"), F.ceil((F.sum("bytes") + 1) / F.lit(float(PASS_BYTES))).cast("int").alias("nj"))
    dealt = sized.join(deal, "key").withColumns({"i": F.pmod(F.xxhash64("id"), F.col("ni")), "j": F.pmod(F.xxhash64("id", F.lit(1)), F.col("nj"))})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    held = dealt.filter("odd").select("key", F.col("i").cast("long").alias("i"), each("nj").alias("j"), F.lit(0).alias("role"), "id", "label")
    met = dealt.select("key", each("ni").alias("i"), F.col("j").cast("long").alias("j"), F.lit(1).alias("role"), "id", "label")
    rows = scratch.save(held.union(met)).join(texts, "id").select("key", "i", "j", "role", "id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels = None, Labels()
        for batch in batches:
            group = list(zip(*[batch.column(c).to_pylist() for c in range(3)]))
            role, ids, label, out = np.asarray(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), []
            for x, y in slices(batch.column(6)):
                found = sets(encoded(batch.column(6).slice(x, y - x)))
                edges = [x, *[k for k in range(x + 1, y) if group[k] != group[k - 1] or role[k] != role[k - 1]], y]
                for a, b in zip(edges[:-1], edges[1:]):
                    if group[a] != now:
                        now, labels = group[a], Labels()
                        own_sets, own_ids, own = [], [], []
                    if role[a] == 0:
                        own_sets, own_ids, own = own_sets + found[a - x : b - x], own_ids + ids[a:b], own + label[a:b]
                    else:
                        out += [(own_ids[i], ids[a + j]) for i, j in joining(own_sets, own, found[a - x : b - x], label[a:b], labels, threshold)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.column(4).type) for c in zip(*out)], ["a", "b"])

    return scratch.save(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role").mapInArrow(run, f"a {kind}, b {kind}").distinct())


def linked(members: DataFrame, texts: DataFrame, sets: Sets, threshold: Threshold, scratch: Scratch) -> DataFrame:
    """The components (id, component) of what links join among the members (key, id, pivot) of buckets; ids that none joins have no row.

    members: a row for each item and bucket with at least two items, the pivot itself included. texts: (id, text), an id
    once. The links are all of a pivot's, and of others as many as the components hang on.
    """
    with scratch.inner() as own:
        stars = own.save(members.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
        first = own.save(verify(stars, texts, sets, threshold, own))
        found = components(first, own)
        # Buckets with one pivot are one group, so that items which share many bands meet once.
        groups = members.select(F.col("pivot").alias("key"), "id").distinct()
        named = own.save(groups.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
        # Groups of the same items give the same links: one of them is enough. One of two items has been compared.
        seen = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("same"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(20,0)")).alias("too"), F.count(F.lit(1)).alias("n"))
        mixed = own.save(seen.filter("c0 <> c1 AND n > 2").groupBy("same", "too", "n").agg(F.min("key").alias("key")).select("key"))
        if mixed.isEmpty():
            return scratch.save(found)
        rest = own.save(named.join(mixed, "key", "left_semi"))
        some = own.save(texts.join(rest.select("id").distinct(), "id", "left_semi"))
        return components(first.union(across(rest, some, sets, threshold, own)), scratch)
