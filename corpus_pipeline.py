"""From raw documents to token ids: language, lines, near duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravet.llm import documents, language, lines, mixing, pieces
from terravet.llm.common import Scratch, importable
from terravet.llm.queries import piece_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters (null and empty texts too), or between two languages, go.

    Repeated rows go or stay together; columns named like the operator's own stay as they are; an empty table stays empty.
    """
    found = language.identify(docs, language.fit(docs.filter(~language.held_out())), keep=tuple(docs.columns))
    own = [f"__{i}" for i in range(len(docs.columns))]
    found = found.toDF(*own, "lang_pred", "score", "margin", "rejected").filter(~F.col("rejected"))
    return found.select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns)])


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line stands for; those that lose all they had go.

    Null and empty texts and rows with a null doc_id stay as they are; repeated rows lose the same lines. n_chars follows the text.
    """
    out = lines.dedup_lines(docs, least=1).filter("n_removed = 0 OR trim(BOTH ' \n\t\r' FROM text) <> ''")
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, as one row, of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without words and rows with a null doc_id are linked with nothing and stay; of repeated rows one stays.
    """
    kept = documents.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count()
    kept = Scratch(spark, "kept").save(kept.select(F.col("doc_id").alias("__id"), "count"))
    alone, again = kept.filter("count = 1").select("__id"), kept.filter("count > 1").select("__id")
    own = lambda ids: docs["doc_id"].cast("long") == ids["__id"]
    rows = docs.join(alone, own(alone), "left_semi").union(docs.filter("doc_id IS NULL"))
    if kept.filter("count > 1").isEmpty():
        return rows
    return rows.union(docs.join(again, own(again), "left_semi").dropDuplicates(["doc_id"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same share, in a random order; a null source is one source. Repeated rows share one count."""
    return mixing.mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to; a null text is the empty one. Other columns go."""
    return pieces.tokenize_joined(docs, piece_model())


STAGES = [("language", known_language), ("lines", distinct_lines), ("near_duplicates", one_of_each), ("mixing", mixture), ("pieces", token_ids)]

#: SQL can't express compression, MinHash or the tokenizer's merges; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is removed once the next one's is written. No documents give no rows."""
    importable(spark)
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        own = scratch.inner()
        docs = own.save(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = own
    return docs
