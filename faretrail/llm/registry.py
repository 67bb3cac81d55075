"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.llm import (
    embedding_dedup, exact_dedup, filter_audit, language_id, line_dedup, ngram_join, packing, pii, secret_scan, source_mixing,
    suffix_dedup, toxicity, whitening,
)


def tokenizer_path() -> str:
    """The byte-level vocabulary that the packing query is defined on."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, threshold=(85, 100))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the base spans; ``spans`` has the added ones too."""
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS], "base_sha256", "spans", "n_added",
    )


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_neardup(_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard_join, op2_exact_dedup, op3_source_mixing, op4_best_fit_packing, op5_pii,
        op6_embedding_neardup, op7_line_dedup, op8_language_id, op9_secret_scan, op10_toxicity,
        op11_suffix_dedup, op12_embedding_whitening, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express."""
    return {
        "op1_ngram_jaccard_join": ngram_join.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op3_source_mixing": source_mixing.SQL,
        "op6_embedding_neardup": embedding_dedup.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
