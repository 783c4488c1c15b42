"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, fingerprints, hard_negatives, line_dedup, mixing, near_dedup, pseudonyms, sampled_pieces, substring_dedup, token_files, toxicity, vp_search, whitening
from .shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda spark, d: substring_dedup.digest(documents(spark, d)),
    "op2_toxicity": lambda spark, d: toxicity.digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op3_mixing": lambda spark, d: mixing.digest(documents(spark, d)),
    "op4_line_dedup": lambda spark, d: line_dedup.digest(spark.read.parquet(f"{d}/pages.parquet")),
    "op5_vp_search": lambda spark, d: vp_search.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op6_fingerprints": lambda spark, d: fingerprints.digest(documents(spark, d)),
    "op7_token_files": lambda spark, d: token_files.digest(documents(spark, d)),
    "op8_pseudonyms": lambda spark, d: pseudonyms.digest(documents(spark, d)),
    "op9_sampled_pieces": lambda spark, d: sampled_pieces.encode(documents(spark, d)),
    "op10_near_dedup": lambda spark, d: near_dedup.digest(documents(spark, d)),
    "op11_whitening": lambda spark, d: whitening.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op12_hard_negatives": lambda spark, d: hard_negatives.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op13_chat_format": lambda spark, d: chat_format.digest(spark.read.parquet(f"{d}/conversations.parquet")),
}

ORACLES: dict[str, str] = {"op3_mixing": mixing.SQL, "op4_line_dedup": line_dedup.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_chat_format": chat_format.SQL}
