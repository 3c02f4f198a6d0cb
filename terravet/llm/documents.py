"""Near-duplicate documents: word shingles, circulant MinHash, exact verification, one document kept of each group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, encoded, slices
from .near import Circulant, Threshold, linked, word_sets

#: 40 bands of 4 coordinates: a pair of similarity 0.85 shares no band once in 10^12, one of 0.8 once in 10^9.
BANDS, ROWS, BITS = 40, 4, 20


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, d0 and d1 (128 bits of the set), bands array<long> of every row; of a row without words null from d0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sets = Circulant(BANDS, ROWS, BITS), word_sets(n)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = sets(encoded(part.column(1)))
                full = [i for i, s in enumerate(found) if len(s)]
                least = np.array([made.least(made.places(found[i])) for i in full]).reshape(len(full), made.k)
                bands = made.band_keys(least).tolist()
                digests = [np.frombuffer(hashlib.blake2b(found[i].tobytes(), digest_size=16).digest(), np.int64) for i in full]
                at = {i: j for j, i in enumerate(full)}
                pick = lambda x: [x[at[i]] if i in at else None for i in range(len(found))]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(pick([int(d[0]) for d in digests]), pa.int64()),
                        pa.array(pick([int(d[1]) for d in digests]), pa.int64()),
                        pa.array(pick(bands), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "d0", "d1", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text); other columns go.

    Documents with `shingle`-word shingle sets of Jaccard similarity num / den or more are linked; component_id is the
    smallest doc_id that links lead to, the document itself included; kept is whether it is the document's own. Equal sets
    are one class and go through banding and verification once. A null or empty text, or one without words, has no shingle
    and is linked with nothing. A row with a null doc_id is linked with nothing, has a null component_id and is kept.
    doc_id is a key: repeated rows count as one document, and each gets the result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    all_rows = scratch.save(signed(docs, shingle))
    with scratch.inner() as own:
        full = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = own.save(full.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep")))
        reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        reps = own.save(reps.select(F.col("doc_id").alias("id"), "bands"))
        entries = reps.select("id", F.explode("bands").alias("key"))
        buckets = entries.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot <> last").select("key", "pivot")
        members = own.save(entries.join(buckets, "key").select("key", "id", "pivot"))
        # These grow with the texts: joined in one way at every size.
        need = members.select("id").distinct().hint("merge")
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
        texts = own.save(texts.join(need, "id", "left_semi").dropDuplicates(["id"]))
        found = linked(members, texts, word_sets(shingle), Threshold(num, den), own)
        named = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("d0", "d1", F.coalesce("component", "rep").alias("component"))
        named = scratch.save(named)
    some = all_rows.select("doc_id", "n_shingles", "d0", "d1")
    none = some.filter("d0 IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    out = some.filter("d0 IS NOT NULL").join(named, ["d0", "d1"], "left").select("doc_id", "n_shingles", "component").union(none)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
