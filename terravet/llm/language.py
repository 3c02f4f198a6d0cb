"""Language identification by compression.

A zstandard raw-content dictionary is cut for every language from a bounded sample of labelled texts. A text is
compressed block by block with each of them; the language whose dictionary gives the fewest bytes is chosen. Where the
second is nearly as small, the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RATES, rate_of

UNKNOWN = "und"
#: Documents that the dictionary of a language is cut from, and characters taken of each, in stretches spread over all of it; the bounds of the fit.
SAMPLE_DOCS, SAMPLE_CHARS, STRETCHES = 400, 1024, 4
#: Bytes of all dictionaries together, which go to every task: with very many languages each has an equal, smaller share.
DICTIONARY_BYTES = 64 << 20
BLOCK_CHARS = 4096
#: A text is rejected if the second language needs less than this share more bytes.
MARGIN = 0.002
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words with one space between; empty if there is no letter."""
    out = OTHER.sub(" ", (text or "").lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def fit(docs: DataFrame, label: str = "lang", per_language: int = SAMPLE_DOCS, seed: int = 11) -> dict[str, bytes]:
    """A dictionary for each label. docs: the labelled rows to learn from (text and label are all that is used).

    Rows are sampled by a hash at a rate that follows each label's count, distinct texts only, and at most
    `per_language` of them are kept, of each SAMPLE_CHARS characters spread over the whole text. Every label that has text
    with letters gets a dictionary. Rows with a null label or without text teach nothing.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("lang"), "text")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    per_language = max(1, min(per_language, DICTIONARY_BYTES // (4 * SAMPLE_CHARS * len(counts))))
    rates = docs.sparkSession.createDataFrame([(r["lang"], rate_of(4 * per_language / r["count"])) for r in counts], "lang string, rate long")
    sample = known.withColumn("key", F.xxhash64(F.lit(seed), "text")).join(F.broadcast(rates), "lang").filter(F.pmod("key", F.lit(RATES)) < F.col("rate"))
    sample = sample.select("lang", "key", spread(F.col("text")).alias("text")).dropDuplicates(["lang", "key"])
    first = sample.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1_000_003)), "key"))).filter(F.col("n") <= per_language)
    parts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "n").select("lang", "text").collect():
        parts.setdefault(r["lang"], []).append(letters(r["text"]))
    return {k: " ".join(x for x in v if x).encode() for k, v in parts.items() if any(v)}


def spread(text: Column) -> Column:
    """A text of at most SAMPLE_CHARS characters whole; of a longer one so many in STRETCHES parts, from its beginning to its end."""
    n, part = F.length(text), SAMPLE_CHARS // STRETCHES
    cut = [F.substring(text, (F.floor((n - part) * F.lit(i) / F.lit(STRETCHES - 1)) + 1).cast("int"), F.lit(part)) for i in range(STRETCHES)]
    return F.when(n <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *cut))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        import zstandard

        self.labels = sorted(dictionaries)
        self.by = []
        for label in self.labels:
            made = zstandard.ZstdCompressionDict(dictionaries[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text by each dictionary, in the order of the labels."""
        out = np.zeros(len(self.by), np.int64)
        for at in range(0, len(text), BLOCK_CHARS):
            block = text[at : at + BLOCK_CHARS].encode()
            out += [len(c.compress(block)) for c in self.by]
        return out

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, float, bool]:
        """Label, score from 0 to 1, margin over the second label, whether it is rejected."""
        clean = letters(text)
        if not clean or not self.labels:
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(clean)
        best = int(np.argmin(sizes))
        weights = np.exp(-(sizes - sizes[best]) / max(1.0, 0.01 * float(sizes[best])))
        second = np.delete(sizes, best)
        gap = float(second.min() - sizes[best]) / float(second.min()) if len(second) else 1.0
        return self.labels[best], float(weights[best] / weights.sum()), gap, gap < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN) -> DataFrame:
    """The columns `keep` of docs, then lang_pred string, score double, margin double, rejected boolean of every row.

    A null or empty text, or one without any letter, is `und` with score 0 and rejected. Ties go to the label that sorts
    first. Whole texts of any length are compressed, in blocks. Without dictionaries everything is `und`.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {docs.schema[k].dataType.simpleString()}" for n, k in zip(names, keep)) + ", lang_pred string, score double, margin double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        for batch in batches:
            rows = [c.predict(t.as_py(), margin) for t in batch.column(0)]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))] if rows else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*names, *added])

    out = docs.select(F.col("text").alias("t"), *[F.col(k).alias(n) for n, k in zip(names, keep)]).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *added)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out of the fit: crc32 of the id's digits modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
