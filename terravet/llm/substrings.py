"""Removal of repeated strings by sorted suffixes.

Strings are of LENGTH bytes, or of PASSAGE words. Every window of such a length has one anchor: the short gram with the
least hash in it, the leftmost of equal ones. Equal windows have equal anchors at the same offset, so only contexts of equal
anchors need comparing. Consecutive windows with one anchor form a run; its context is the bytes or words of them all. A
context that occurs twice is repeated throughout. The distinct contexts of an anchor have their suffixes from the anchor on,
and their reversed prefixes before it, sorted by deep-shallow sorting: multikey quicksort to a shallow depth, then a blind
trie for each group that agrees that far. The common prefixes of neighbours in the two orders say which windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, encoded, joined, mix, powers, prefix_sums, slices, stretch_hashes, words
from .near import grouped

LENGTH, GRAM = 400, 64
#: A passage has over 50 words.
PASSAGE, WORD_GRAM = 51, 5
#: Bytes that quicksort looks at, and at a time.
SHALLOW, WORD = 32, 8
#: Distinct contexts of one anchor that are sorted in one task; the windows of a larger group are counted by a shuffle.
GROUP = 20_000
#: Bytes of text in one array.
PLACES = 1 << 23


@dataclass(frozen=True)
class Units:
    """What strings are made of: `length` units of `size` bytes, with grams of `gram` units. Words stand as their 8-byte hashes."""

    length: int
    gram: int
    size: int

    @property
    def span(self) -> int:
        return self.length - self.gram + 1

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Of all texts together: unit where each starts and ends, the units' bytes, hashes of the grams; of words, start and end in the text."""
        data, starts, ends = joined(texts)
        if self.size == 1:
            sums, n = prefix_sums(data), max(0, len(data) - self.gram)
            _, down = powers(len(data) + 1)
            return starts, ends, data.tobytes(), mix((sums[self.gram : self.gram + n] - sums[:n]) * down[:n]), None, None
        s, e = words(data)
        h = stretch_hashes(prefix_sums(data), s, e)
        bounds = np.searchsorted(s, np.concatenate([starts, [len(data)]]))
        odd, n = mix(np.arange(1, self.gram + 1, dtype=np.uint64)) | np.uint64(1), max(0, len(h) - self.gram + 1)
        grams = mix(sum((h[j : n + j] * odd[j] for j in range(self.gram)), np.zeros(n, np.uint64)))
        move = np.repeat(starts, np.diff(bounds))
        return bounds[:-1], bounds[1:], h.byteswap().tobytes(), grams, s - move, e - move

    def reversed(self, x: bytes) -> bytes:
        return x[::-1] if self.size == 1 else np.frombuffer(x, np.int64)[::-1].tobytes()


BYTES, WORDS = Units(LENGTH, GRAM, 1), Units(PASSAGE, WORD_GRAM, 8)


# --- deep-shallow sorting


class Blind:
    """A blind trie: inner nodes hold the depth at which their strings first differ and a child for each byte there."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the common prefix."""
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def at(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> int | None:
        """Put string i in; if an equal one is there, return that instead."""
        node = self.root
        while not isinstance(node, int):  # blind: only the bytes at branching depths are looked at
            depth, children = node
            node = children.get(self.at(i, depth), next(iter(children.values())))
        leaf = node
        agree = self.common(self.strings[i], self.strings[leaf])
        if agree == len(self.strings[i]) == len(self.strings[leaf]):
            return leaf
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < agree:
            parent, node = node, node[1][self.at(i, node[0])]
        if not isinstance(node, int) and node[0] == agree:
            node[1][self.at(i, agree)] = i
            return None
        made = [agree, {self.at(leaf, agree): node, self.at(i, agree): i}]
        if parent is None:
            self.root = made
        else:
            parent[1][self.at(i, parent[0])] = made
        return None

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def blind_sorted(strings: list[bytes], group: list[int]) -> list[int]:
    trie, equal = Blind(strings, group[0]), {}
    for i in group[1:]:
        if (twin := trie.add(i)) is not None:
            equal.setdefault(twin, []).append(i)
    return [j for i in trie.order() for j in (i, *equal.get(i, ()))]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The sorted order of strings, and for each place the common prefix with the string before it (first: 0)."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_sorted(strings, group)
        else:
            end = depth + WORD
            keys = [strings[i][depth:end] for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys) if k < pivot]
            same = [i for i, k in zip(group, keys) if k == pivot]
            more = [i for i, k in zip(group, keys) if k > pivot]
            ended = len(pivot) < WORD
            todo += [(more, depth), (same, shallow if ended else end), (less, depth)]
    return out, [0, *[Blind.common(strings[a], strings[b]) for a, b in zip(out[:-1], out[1:])]][: len(out)]


# --- which windows of a group's contexts are repeated


def repeated(left: list[bytes], right: list[bytes], kind: Units = BYTES) -> np.ndarray:
    """(contexts, length + 1) booleans: whether the window that begins t units before the anchor, which context i holds
    whole, stands in another of the contexts too. left: units before the anchor; right: from the anchor on."""
    m, size, length = len(left), kind.size, kind.length
    low = np.array([max(0, length - len(r) // size) for r in right])
    high = np.array([len(x) // size for x in left])
    l_order, l_common = deep_shallow([kind.reversed(x) for x in left])
    r_order, r_common = deep_shallow(right)
    l_common, r_common = [x // size for x in l_common], [x // size for x in r_common]
    marks = np.zeros((m, length + 2), np.int32)
    if m <= 512:
        common = []
        for order, lcp in ((l_order, l_common), (r_order, r_common)):
            table, at, lcp = np.zeros((m, m), np.int32), np.array(order), np.array(lcp)
            for i in range(m - 1):
                run = np.minimum.accumulate(lcp[i + 1 :])
                table[at[i], at[i + 1 :]] = run
                table[at[i + 1 :], at[i]] = run
            common.append(table)
        first = np.maximum(length - common[1], np.maximum(low[:, None], low[None, :]))
        last = np.minimum(common[0], np.minimum(high[:, None], high[None, :]))
        np.fill_diagonal(last, -1)
        i, j = np.nonzero(first <= last)
        np.add.at(marks, (i, first[i, j]), 1)
        np.add.at(marks, (i, last[i, j] + 1), -1)
        return np.cumsum(marks, axis=1)[:, : length + 1] > 0
    out = np.zeros((m, length + 1), bool)
    l_lcp, r_lcp, l_at, r_at = np.array(l_common), np.array(r_common), np.array(l_order), np.array(r_order)
    for t in range(int(low.min()), int(high.max()) + 1):
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[l_at], b[r_at] = np.cumsum(l_lcp < t), np.cumsum(r_lcp < length - t)
        own = np.flatnonzero((low <= t) & (t <= high))
        _, back, n = np.unique(a[own] * (m + 1) + b[own], return_inverse=True, return_counts=True)
        out[own[n[back] > 1], t] = True
    return out


def stretches(row: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


# --- runs of windows


def anchored(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: Units = BYTES) -> tuple[np.ndarray, ...]:
    """Of all texts' runs: text, first window, last window, anchor, all as places in the array of units, and the anchor's hash."""
    n, span = len(grams), kind.span
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < span:
        return none
    least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width :][: n - span + 1])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(n - span + 2, np.int32)
    fits = ends - starts >= kind.length
    np.add.at(inside, np.minimum(starts[fits], n - span + 1), 1)
    np.add.at(inside, np.minimum(ends[fits] - kind.length + 1, n - span + 1), -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return none
    text = np.searchsorted(ends, windows, "right")
    own = anchor[windows]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(windows) - 1]])
    return text[first], windows[first], windows[last], own[first], grams[own[first]]


def parts(texts: list[bytes], kind: Units = BYTES) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """Texts to work on together, each with its number and the byte and unit where it begins; a text beyond PLACES in pieces whose windows follow on."""
    batch, numbers = [], []
    for i, t in enumerate(texts):
        if len(t) <= PLACES:
            batch.append(t)
            numbers.append(i)
        elif kind.size == 1:
            for at in range(0, len(t) - kind.length + 1, PLACES):
                yield [t[at : at + PLACES + kind.length - 1]], [i], [at], [at]
        else:
            data, _, _ = joined([t])
            s, e = words(data)
            step = max(1, PLACES // kind.size)
            for at in range(0, len(s) - kind.length + 1, step):
                stop = min(len(s), at + step + kind.length - 1)
                yield [t[s[at] : e[stop - 1]]], [i], [int(s[at])], [at]
    if batch:
        yield batch, numbers, [0] * len(batch), [0] * len(batch)


def runs(docs: DataFrame, kind: Units = BYTES) -> DataFrame:
    """(t, gram, c0, c1, first, last, anchor, b0, b1, b2) of each run: digest of the text, anchor's hash, digest of the context, places in units;
    and the bytes where the context begins, its anchor begins and it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                names = batch.column(0).slice(a, b - a)
                for texts, numbers, begins, before in parts(encoded(batch.column(1).slice(a, b - a)), kind):
                    starts, ends, raw, grams, unit_start, unit_end = kind.of(texts)
                    text, first, last, anchor, gram = anchored(grams, starts, ends, kind)
                    if not len(text):
                        continue
                    size, stop = kind.size, last + kind.length
                    digest = b"".join(
                        [hashlib.blake2b(raw[f * size : e * size], digest_size=16, salt=o.to_bytes(2, "big")).digest() for f, e, o in zip(first.tolist(), stop.tolist(), (anchor - first).tolist())]
                    )
                    c = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    move, shift = np.array(before)[text] - starts[text], np.array(begins)[text]
                    places = [x + move for x in (first, last, anchor)]
                    places += [x + move for x in (first, anchor, stop)] if unit_start is None else [x + shift for x in (unit_start[first], unit_start[anchor], unit_end[stop - 1])]
                    cols = [names.take(pa.array(np.array(numbers)[text])), pa.array(gram.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), *[pa.array(x.astype(np.int32)) for x in places]]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "gram", "c0", "c1", "first", "last", "anchor", "b0", "b1", "b2"])

    schema = "t binary, gram long, c0 long, c1 long, first int, last int, anchor int, b0 int, b1 int, b2 int"
    return docs.select(name(F.col("text")).alias("t"), "text").filter("text IS NOT NULL").mapInArrow(run, schema)


def name(text: Column) -> Column:
    """A text's identity, of 128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def sorted_groups(contexts: DataFrame, kind: Units = BYTES) -> DataFrame:
    """(c0, c1, low, high): stretches of repeated windows, as offsets of the anchor, of contexts (gram, c0, c1, n, left, right)."""

    def units(texts: list[bytes]) -> list[bytes]:
        if kind.size == 1:
            return texts
        starts, ends, raw, *_ = kind.of(texts)
        return [raw[a * 8 : b * 8] for a, b in zip(starts.tolist(), ends.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []
        for _, c0, c1, n, left, right in grouped(batches, 1):
            if len(n) > 1 and min(n) == 1:
                found = repeated(units(left), units(right), kind)
                for i in range(len(n)):
                    if n[i] == 1 and found[i].any():
                        rows += [(c0[i], c1[i], a, b) for a, b in stretches(found[i])]
            if len(rows) > 5000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def table(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        a = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), pa.array(a[:, 3].astype(np.int32))], ["c0", "c1", "low", "high"])

    return contexts.select("gram", "c0", "c1", "n", "left", "right").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "c0 long, c1 long, low int, high int")


def counted_windows(contexts: DataFrame, kind: Units = BYTES) -> DataFrame:
    """The same as sorted_groups for groups too large for one task: each window is a row, and equal ones are counted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i in range(batch.num_rows):
                starts, ends, raw, *_ = kind.of([left[i], right[i]])
                size, l = kind.size, int(ends[0] - starts[0])
                whole = raw[starts[0] * size : ends[0] * size] + raw[starts[1] * size : ends[1] * size]
                at = range(len(whole) // size - kind.length + 1)
                digests = [hashlib.blake2b(whole[x * size : (x + kind.length) * size], digest_size=16).digest() for x in at]
                cols = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([l - x for x in at], pa.int32()), pa.array(digests, pa.binary())], ["gram", "c0", "c1", "n", "low", "window"])

    each = contexts.select("gram", "c0", "c1", "n", "left", "right").mapInArrow(windows, "gram long, c0 long, c1 long, n long, low int, window binary")
    many = each.groupBy("gram", "low", "window").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return each.filter("n = 1").join(many, ["gram", "low", "window"], "left_semi").select("c0", "c1", "low", F.col("low").alias("high"))


def spans(docs: DataFrame, scratch: Scratch, kind: Units = BYTES, group: int = GROUP) -> DataFrame:
    """(t, starts array<int>, ends array<int>): the disjoint stretches of each text, in units, that repeated strings cover."""
    with scratch.inner() as own:
        with own.inner() as first:
            every = first.save(runs(docs, kind))
            again = every.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("gram")
            found = own.save(every.join(again, "gram", "left_semi"))
        at = F.struct("t", "b0", "b1", "b2")
        offsets = [(F.col("anchor") - F.col("last")).alias("low"), (F.col("anchor") - F.col("first")).alias("high")]
        contexts = own.save(found.groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n"), F.first("gram").alias("gram"), F.min(at).alias("at"), *[F.first(x).alias(n) for x, n in zip(offsets, ("low", "high"))]))
        meet = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("single")).filter("k > 1 AND single = 1").select("gram", "k")
        rest = own.save(contexts.join(meet, "gram").select("gram", "k", "c0", "c1", "n", "at.*"))
        need = rest.select("t").distinct()
        texts = docs.select(name(F.col("text")).alias("t"), F.col("text").cast("binary").alias("b")).filter("b IS NOT NULL").join(need, "t", "left_semi")
        bytes_ = lambda a, b: F.substring("b", F.col(a) + 1, F.col(b) - F.col(a))
        cut = rest.join(texts, "t").select("gram", "k", "c0", "c1", "n", bytes_("b0", "b1").alias("left"), bytes_("b1", "b2").alias("right"))
        # Copies of a text give its contexts several times over.
        cut = own.save(cut.dropDuplicates(["c0", "c1"]))
        edges = sorted_groups(cut.filter(F.col("k") <= group), kind).union(counted_windows(cut.filter(F.col("k") > group), kind))
        covered = own.save(contexts.filter("n > 1").select("c0", "c1", "low", "high").union(edges))
        places = found.join(covered, ["c0", "c1"]).select("t", F.struct((F.col("anchor") - F.col("high")).alias("a"), (F.col("anchor") - F.col("low") + kind.length).alias("b")).alias("s"))
        lists = places.groupBy("t").agg(F.sort_array(F.collect_set("s")).alias("s")).select("t", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
        return scratch.save(lists.mapInArrow(merged, "t binary, starts array<int>, ends array<int>"))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches joined where they meet."""
    for batch in batches:
        starts, ends = [], []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x, y = [a[0]], [b[0]]
            for s, e in zip(a[1:], b[1:]):
                if s <= y[-1]:
                    y[-1] = max(y[-1], e)
                else:
                    x.append(s)
                    y.append(e)
            starts.append(x)
            ends.append(y)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["t", "starts", "ends"])


def passages(docs: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(t, passage_words): how many words of each text, by its digest, lie in a string of PASSAGE words that also stands elsewhere."""
    found = spans(docs, scratch, WORDS, group)
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x)
    return scratch.save(found.select("t", (total("ends") - total("starts")).cast("long").alias("passage_words")))


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary (the bytes that stay), passage_words of every row of docs; other columns go.

    Each byte of a text (UTF-8) that a string of LENGTH bytes covers which also starts anywhere else, in the same text or
    another, is removed; strings are judged on the input. Every copy of a repeated string goes. Strings never cross texts,
    and a text shorter than LENGTH, a null or an empty one loses nothing (null: no bytes). Rows are texts whatever their
    ids: repeated rows are copies of each other, and a null id is an id. Texts of any length are whole. passage_words counts
    the words (runs of bytes that aren't ASCII white space) within repeated strings of PASSAGE words, whatever their bytes
    and the white space between them; they are reported, and removed only where the rule for bytes says so.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = docs.select("text")
    gone, told = spans(texts, scratch, BYTES, group), passages(texts, scratch, group)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, sha, kept = [], [], [], [], []
            for raw, a, b in zip(encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rest = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)])) if a else raw
                n.append(len(raw))
                removed.append(len(raw) - len(rest))
                count.append(len(a or ()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, count)], pa.array(sha, pa.string()), pa.array(kept, pa.binary()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "passage_words"])

    rows = docs.select("doc_id", "text", name(F.col("text")).alias("t"))
    # Both sides are by text: one table of what is known of each, so that the texts move once at most.
    known = scratch.save(gone.join(told, "t", "full_outer"))
    joined_ = rows.join(known, "t", "left").select("doc_id", "text", "starts", "ends", F.coalesce("passage_words", F.lit(0).cast("long")))
    return joined_.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, passage_words long")
