"""How the queries of this subpackage read their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import heavy
from ..plans.lineage import cut, shared_dir, shared_path, until_the_end

__all__ = ["cut", "documents", "heavy", "shared_dir", "shared_path", "until_the_end", "unused"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores put before them as no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
