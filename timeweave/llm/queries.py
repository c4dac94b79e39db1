"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import bpe, ctw, exact_dedup, jaccard_join, knn, language_id, packing, secret_scan, toxicity, warc
from timeweave.llm.common import id_crc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of every page, read back and put in global order."""
    found = warc.warc_index(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "history_position")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.language_id(docs, language_id.learn(language_id.training_rows(docs)))
    return found.withColumn("held_out", id_crc(F.col("doc_id")) % 4 == 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return found.withColumn("held_out", id_crc(F.col("doc_id")) % 3 == 1)


def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a context-tree mixture."""
    return ctw.score_documents(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with ownership counts."""
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    vectors = knn.quantise(_table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document; the largest doc_id stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and their decoding."""
    import public_tokenizers

    return bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_context_tree_weighting": op5_context_tree_weighting,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_voronoi_knn": op8_voronoi_knn,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": warc.ORACLE_SQL,
    "op8_voronoi_knn": knn.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
