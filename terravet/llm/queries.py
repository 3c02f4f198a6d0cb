"""The registered query of each operator and, where SQL can express it, its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, documents, exact, language, licences, lines, media, mixing, pieces, quality, spelling, substrings, vectors
from .common import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.fit(docs.filter(~language.held_out()))
    out = language.identify(docs, dictionaries)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.tokenize_joined(table(spark, sf_dir, "documents"), piece_model())
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), least=1)
    return out.select("doc_id", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.product_codes(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    digest = F.sha2(F.lit(codes.text_of(books)).cast("binary"), 256)
    return codes.with_label_errors(found).select("vec_id", digits.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language": op1_language, "op2_licences": op2_licences, "op3_neighbours": op3_neighbours, "op4_media": op4_media, "op5_quality": op5_quality, "op6_substrings": op6_substrings, "op7_pieces": op7_pieces, "op8_near_duplicates": op8_near_duplicates, "op9_lines": op9_lines, "op10_mixing": op10_mixing, "op11_codes": op11_codes, "op12_exact": op12_exact, "op13_spelling": op13_spelling}
#: The exact answer, for measuring recall; the operator is approximate, so this is no statement of the query.
OP3_EXACT_SQL = """
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20
"""

ORACLE_SQL = {"op10_mixing": mixing.OP10_SQL, "op11_codes": codes.statement(), "op12_exact": exact.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
