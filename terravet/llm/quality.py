"""Quality by an ordinal cumulative-link regression on graded ratings.

P(grade <= k) is the logistic function of threshold k less the text's score; the score is one weight vector over hashed
words and word shapes, shared by all grades, and the thresholds ascend. The model is fitted on a bounded sample of
labelled rows and applied to every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RATES, Scratch, rate_of

BITS = 18
#: Labelled rows that the fit uses, as many of each grade where there are, and features of them all together; rows are taken whole.
SAMPLE_ROWS, SAMPLE_FEATURES = 9000, 8_000_000
#: A text is kept if its top grade is at least so probable.
KEEP = 0.5
STEPS, RATE, PENALTY = 120, 0.3, 2e-6

WORD = re.compile(r"\S+")
SHAPE = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each; other characters stay."""
    for pattern, sign in SHAPE:
        word = pattern.sub(sign, word)
    return word


class Features:
    """Hashed features of a text; those of a word are computed once and remembered, up to a bound."""

    def __init__(self, bits: int = BITS, most: int = 300_000):
        self.mask, self.most, self.known = (1 << bits) - 1, most, {}

    def of(self, word: str) -> tuple[int, ...]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            low = word.lower()
            core = low.strip(".,;:!?*#$%&()[]{}\"'|<>")
            names = {f"w{core or low}", f"s{shape(word)}"}
            if core and core != low:
                names.add(f"p{low[len(low.rstrip('.,;:!?*#$%&()[]{}')):]}")
            found = self.known[word] = tuple(zlib.crc32(n.encode()) & self.mask for n in sorted(names))
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values: log counts scaled by the square root of the number of places."""
        counts: Counter[int] = Counter()
        for word, n in Counter(WORD.findall(text or "")).items():
            for at in self.of(word):
                counts[at] += n
        places = np.fromiter(counts.keys(), np.int32, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        return places, values / np.sqrt(max(1, len(counts)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade for each score."""
        below = logistic(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[places] @ values)


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, bits: int = BITS) -> Ordinal:
    """Maximum penalised likelihood by full-batch Adam; the thresholds are a first one and positive steps."""
    y = np.array([r[0] for r in rows], np.int64)
    at = np.concatenate([r[1] for r in rows]).astype(np.int64)
    value = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    theta = np.concatenate([np.zeros(len(used)), [-1.0], np.full(grades - 2, 0.5)])
    weigh = len(y) / (grades * np.bincount(y, minlength=grades).clip(1))[y]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        cuts = theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
        score = np.bincount(owner, theta[at] * value, len(y))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = logistic(np.clip(edges[y + 1] - score, -40, 40)), logistic(np.clip(edges[y] - score, -40, 40))
        high, low = np.where(y == grades - 1, 1.0, high), np.where(y == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p * weigh, low * (1 - low) / p * weigh
        gs = (dh - dl) / len(y)
        gcut = np.zeros(grades - 1)
        for k in range(grades - 1):
            gcut[k] = -(dh[y == k].sum() - dl[y == k + 1].sum()) / len(y)
        g = np.empty_like(theta)
        g[: len(used)] = np.bincount(at, gs[owner] * value, len(used)) + PENALTY * theta[: len(used)]
        g[len(used)] = gcut.sum()
        for k in range(1, grades - 1):
            g[len(used) + k] = gcut[k:].sum() * np.exp(theta[len(used) + k])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(1 << bits)
    weights[used] = theta[: len(used)]
    return Ordinal(weights, theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES, seed: int = 5) -> Ordinal | None:
    """docs: doc_id, text. ratings: doc_id, grade from 0 to grades - 1; null grades and ids teach nothing. None without ratings.

    Rows are sampled by a hash of the id, at a rate that follows each grade's count; a text counts once, with its worst grade.
    All features of a sampled text teach, as all are scored; texts are taken in the order of a hash until sample_features are.
    """
    rated = ratings.filter(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    counts = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    rate = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(rate_of(sample_rows / grades / n)))])
    key = F.xxhash64(F.lit(seed), "doc_id")
    sample = rated.filter(F.pmod(key, F.lit(RATES)) < rate[F.col("grade")]).orderBy(key, "doc_id", "grade").limit(2 * sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            packed = [pa.array([x[c].tobytes() for x in found], pa.binary()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(p) for p, _ in found], pa.int64()), *packed], ["key", "grade", "n", "places", "values"])

    chosen = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select(F.xxhash64("text").alias("key"), "text", "grade")
    rows = chosen.mapInArrow(run, "key long, grade int, n long, places binary, values binary").groupBy("key").agg(F.min(F.struct("grade", "n", "places", "values")).alias("r"))
    so_far = F.sum("n").over(Window.orderBy("key"))  # a window over two numbers of each row of the bounded sample
    with Scratch(docs.sparkSession, "quality") as own:
        rows = own.save(rows.select("key", "r.*"))
        taken = rows.select("key", "n").withColumn("so_far", so_far).filter((F.col("so_far") <= sample_features) | (F.col("so_far") == F.col("n")))
        rows = rows.join(F.broadcast(taken.select("key")), "key", "left_semi").orderBy("key").collect()
    rows = [(r["grade"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float64)) for r in rows if r["n"]]
    return fit_rows(rows, grades) if rows else None


def grade(docs: DataFrame, model: Ordinal | None, keep: float = KEEP, id_col: str = "doc_id") -> DataFrame:
    """The id, expected_grade double, tail_prob double (of the top grade), kept boolean of every row; other columns go.

    Whole texts of any length are scored. A null or empty text, or one of white space, has no grounds for a grade:
    expected_grade and tail_prob are 0 and it isn't kept; the same holds for every text without a model. Repeated rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_prob"), F.lit(False).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, top = Features(), len(model.thresholds)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            some = np.array([len(p) > 0 for p, _ in found], bool)
            p = model.grades(np.array([model.score(*x) for x in found], np.float64))
            expected = np.where(some, p @ np.arange(top + 1), 0.0)
            tail = np.where(some, p[:, top], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= keep)], ["key", "expected_grade", "tail_prob", "kept"])

    out = docs.select(F.col(id_col).alias("key"), "text").mapInArrow(run, f"key {kind}, expected_grade double, tail_prob double, kept boolean")
    return out.withColumnRenamed("key", id_col)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the table of labels: 0 toxic, 1 of poor quality, 2 good. Several labels of one id: the worst."""
    value: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.groupBy("doc_id").agg(F.min(value).alias("grade"))
