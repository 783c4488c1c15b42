"""Statistical detection of languages: profiles of character 3-grams, learned from labelled texts, applied by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_shingles


def profiles(texts: DataFrame, text: str, language: str, most: int = 300) -> DataFrame:
    """``gram, language, weight``: of the ``most`` grams of each language that most of its texts hold, the log share of every language's texts.

    The table has at most (languages squared) times ``most`` rows, whatever the number of texts.
    """
    rows = texts.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("language"), F.explode(F.array(char_shingles(text))).alias("g"))
    sizes = rows.groupBy("language").agg(F.count("*").alias("n"))
    counts = rows.select("language", F.explode_outer("g").alias("gram")).filter("gram is not null").groupBy("language", "gram").agg(F.count("*").alias("df"))
    best = counts.withColumn("at", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("df"), "gram"))).filter(F.col("at") <= most)
    wanted = best.select("gram").distinct().join(F.broadcast(sizes))  # the chosen grams for each of a few languages
    found = wanted.join(counts, ["language", "gram"], "left")
    return found.select("gram", "language", F.log(F.greatest(F.coalesce(F.col("df") / F.col("n"), F.lit(0.0)), F.lit(0.001))).alias("weight"))


def detect(texts: DataFrame, id_col: str, text: str, known: DataFrame) -> DataFrame:
    """``id, language, confidence`` of each text by summed weights of its grams; unknown and 0 where it has none that is known."""
    rows = texts.select(F.col(id_col).alias("id"), F.explode_outer(char_shingles(F.coalesce(text, F.lit("")))).alias("gram"))
    sums = rows.join(F.broadcast(known), "gram").groupBy("id", "language").agg(F.sum("weight").alias("score"))  # a table of bounded size
    of = Window.partitionBy("id")
    sums = sums.withColumn("best", F.max("score").over(of))
    both = sums.groupBy("id").agg(F.min_by("language", F.struct(-F.col("score"), F.col("language"))).alias("language"), F.round(1 / F.sum(F.exp(F.col("score") - F.col("best"))), 4).alias("confidence"))
    return texts.select(F.col(id_col).alias("id")).join(both, "id", "left").select("id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
