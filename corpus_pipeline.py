"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Null and empty texts pass through: they score 0, have no lines, are nobody's copy and have no words and no pieces; a source without words is
not mixed in, so its rows go there.  Rows with null ids are kept by near dedup and draw as one id; null sources are one source; repeated rows are rows
each, and copies of one id.  Extra columns come back from all stages but the last as they were, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import line_dedup, mixing, near_dedup, sampled_pieces, toxicity
from claimlake.llm.shared import documents, shared_path, until_the_end, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half; the model is trained on this stage's own rows that have labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "toxicity_of_row")
    return toxicity.scored(docs, model, docs.columns, name=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over 5 % of their source's distinct texts share, 5 texts at least."""
    rows = line_dedup.drop_boilerplate(docs, "source", "text", ratio=0.05, least_pages=5, once=True, counts=False)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    classes = near_dedup.near_duplicates(docs, shingle=5, threshold=(80, 100))
    return docs.join(classes.filter("not kept").select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document."""
    return sampled_pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("piece sampling", encode_pieces)]

#: SQL can't express the toxicity, near dedup and sampling stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet, which lasts as long as the application, and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        until_the_end(spark, path)
        docs = spark.read.parquet(path)
    return docs
