"""The chunks that are read back are those that were written, once each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.llm import media
from terravet.llm.common import Scratch


@pytest.fixture(scope="module")
def docs(spark):
    """Three texts twice each, and two long ones that share most of their chunks."""
    rng = np.random.default_rng(2)
    long = "".join(map(chr, rng.integers(97, 123, 120_000)))
    rows = [(i, f"text {i % 3} " * 900) for i in range(6)] + [(10, long), (11, "begun otherwise " + long), (12, None), (None, "text 0 " * 900)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_chunks_are_read_from_a_table(spark, docs):
    _, packs, lent = media.store(docs, Scratch(spark, "stored"))
    plan = packs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Scan parquet" in plan and len(packs.inputFiles()) > 0
    assert media.read_back(packs, lent).count() == 6 and lent.count() > 5


def test_every_chunk_is_stored_once(spark, docs):
    _, packs, _ = media.store(docs, Scratch(spark, "once"))
    texts = {r["text"] for r in docs.collect()}
    expected = {d for t in texts for d, _ in media.chunked(media.to_media(media.padded((t or "").encode())))}
    stored = [bytes(r[0]) for r in packs.select(F.explode("digests")).collect()]
    assert len(stored) == len(set(stored)) and set(stored) == expected


def test_a_damaged_chunk_is_met(spark, docs, monkeypatch):
    """Bytes that change between storing and reading raise an error."""
    save = Scratch.save
    damaged = F.transform("chunks", lambda x: F.concat(x, F.lit("x").cast("binary")))
    monkeypatch.setattr(Scratch, "save", lambda self, df: save(self, df).withColumn("chunks", damaged) if "chunks" in df.columns else save(self, df))
    with pytest.raises(Exception, match="is damaged"):
        media.media_column(docs).count()


def test_a_lost_chunk_is_met(spark, docs):
    _, packs, lent = media.store(docs, Scratch(spark, "lost"))
    with pytest.raises(Exception, match="lacks chunks"):
        media.read_back(packs.filter("whole OR size(places) < 0"), lent.filter("place > 1").union(lent.filter("place = 1").limit(0))).count()
