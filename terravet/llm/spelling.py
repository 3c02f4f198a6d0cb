"""Spelling variants: words within one edit, found by PartEnum over letter multisets.

A word's letters, each with the number of its occurrence, are a set, that is a binary vector; one edit changes it in at most two
places. Vectors are cut in PARTS parts by a hash of the place, and two that differ in at most two places agree on all but two
parts; so each of the PARTS * (PARTS - 1) / 2 choices of two parts to leave out gives a signature of what is left, and vectors that
share none are further apart. Words of the same letters have the same vector, so the join is between distinct vectors; its pairs
are verified on the vectors, then led to their words by the half of the letters that one edit leaves as it is, and these verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix

#: Parts of a vector.
PARTS = 8
#: Words that a counting task holds before it sends them.
HELD = 200_000
#: Runs are looked for in Latin-1, where the letters asked for are single bytes: A-Z become small, the letters stay, all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted(docs: DataFrame, least_length: int, slip: int) -> DataFrame:
    """(word, n) of the words of at least this length, a count for each task and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = zlib.crc32(f"{doc or ''}:".encode())
                for w, n in Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                    size = len(w)
                    if size < least_length:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if not h % slip:
                        if size == least_length:
                            continue
                        w = w[: h % size] + w[h % size + 1 :]
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD:
                    yield flushed()
                    counts = {}
        if counts:
            yield flushed()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")


def signatures(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(letters, keys array<long>): the signatures of each word's sorted letters, one for each two parts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = list(combinations(range(parts), 2))
        names = mix(np.arange(1, len(pairs) + 1, dtype=np.uint64))
        for batch in batches:
            words = batch.column(0).to_pylist()
            sizes = np.array([len(w) for w in words], np.int64)
            owner = np.repeat(np.arange(len(words)), sizes)
            code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            at = np.arange(len(code))
            number = at - np.maximum.accumulate(np.where(new, at, 0))
            place = mix((code << np.uint64(32)) + number.astype(np.uint64))
            part = (place % np.uint64(parts)).astype(np.int64)
            sums = np.zeros((len(words), parts), np.uint64)
            np.add.at(sums, (owner, part), mix(place + np.uint64(1)))
            whole = sums.sum(axis=1, dtype=np.uint64)
            keys = np.empty((len(words), len(pairs)), np.uint64)
            for k, (i, j) in enumerate(pairs):
                keys[:, k] = mix((whole - sums[:, i] - sums[:, j]) ^ names[k])
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * len(pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))], ["letters", "keys"])

    return vectors.select("letters").mapInArrow(run, "letters string, keys array<long>")


def places(letters: str) -> Column:
    """A vector's places that hold one: each letter with the number of its occurrence, of sorted letters."""
    return F.expr(f"transform(split({letters}, ''), (x, i) -> concat(x, i + 1 - locate(x, {letters})))")


def near_vectors(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(short, long): the pairs of distinct vectors, as sorted letters, that differ in one or two places and in length by one at most."""
    vectors = words.select("letters").distinct()
    keyed = scratch.save(signatures(vectors).select("letters", F.explode("keys").alias("key")))
    a, b = (keyed.select("key", F.col("letters").alias(c)) for c in ("a", "b"))
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 2) >= 0)
    met = a.join(b, (a["key"] == b["key"]) & close).select("a", "b").distinct()
    differ = F.length("a") + F.length("b") - 2 * F.size(F.array_intersect(places("a"), places("b")))
    first = F.length("a") <= F.length("b")
    pair = met.filter(differ <= 2).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("long"))
    return scratch.save(pair)


def halves(word: str, size: Column) -> Column:
    """The first half of a word of `size` letters, and as many last letters as its second half has: of two words within one edit, `size` the length of the shorter, one of both is the same."""
    half = F.floor(size / 2).cast("int")
    first, last = F.substring(F.col(word), F.lit(1), half), F.substring(F.col(word), F.length(word) - size + half + 1, size - half)
    return F.array(F.concat(F.lit("<"), first), F.concat(F.lit(">"), last))


def near_words(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, na, b, nb): the pairs of words (word, n, letters) whose vectors are a pair and that are one edit apart, once each."""
    size = F.length("short")
    left = words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("letters").alias("short")).join(pairs, "short")
    left = left.select("a", "na", "long", size.alias("size"), F.explode(halves("a", size)).alias("half"))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letters").alias("long"), F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size"))
    right = right.select("b", "nb", "long", "size", F.explode(halves("b", F.col("size"))).alias("half"))
    both = left.join(right, ["long", "size", "half"])
    # What agrees in both halves has met twice.
    once = F.col("half").startswith("<") | (halves("a", F.col("size"))[0] != halves("b", F.col("size"))[0])
    return both.filter((F.levenshtein("a", "b", 1) == 1) & once).select("a", "na", "b", "nb")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the forms (word, form) lead; each round goes twice as far, and a form's n being the larger there are no circles."""
    up = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        if new.filter("went").isEmpty():
            return new.select("word", "root")
        up = new.select("word", "root")


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, slip: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z made small; a run loses one letter where `slip` divides the
    CRC-32 of `<doc_id>:<run>` (a null doc_id is written as nothing). Of these, words of at least `least_length` letters and
    `least_n` occurrences count. Two are near if one letter inserted, deleted or replaced makes one of the other. A word's
    form is its near word of largest n, ties to the smallest in code-point order, if its n is at least `times` the word's; root
    is where forms lead. A null or empty text has no words; texts are read whole; repeated rows count each; other columns
    don't matter; a table without words gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    with scratch.inner() as own:
        total = counted(docs, least_length, slip).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)
        words = own.save(total.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters")))
        found = own.save(near_words(words, near_vectors(words, own)))
        both = found.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(found.select("b", "a", "na"))
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
        fit = -F.col("best.m") >= F.lit(times) * F.col("n")
        named = words.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(fit, x).alias(c) for c, x in (("form", F.col("best.other")), ("form_n", -F.col("best.m")))])
        named = own.save(named)
        led = roots(named.filter("form IS NOT NULL"), own)
        out = named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.save(out)


#: CRC-32 by its table, which follows from the polynomial; near words meet by what is left of them without one letter.
OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(c, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS t FROM (SELECT unnest(range(256)) AS c)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
each AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(named))), lambda i: ('0x' || substr(hex(encode(named)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM each, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, other, m FROM (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN words b ON a.rest = b.word)
  UNION SELECT b.word, a.word AS other, a.n AS m FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
led(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT l.word, f.form FROM led l JOIN forms f ON l.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON f.word = l.word JOIN forms e ON l.root = e.word WHERE e.form IS NULL
"""
