"""Mixing sources to target weights by repeating documents.

Sizes are summed by source; each source's target is its weight's share of all words,
held at ``most_copies`` times its own words, the excess going to the others by weight.  A
document is emitted floor(rate) times, and once more when a number drawn from its id and
the seed is below the fraction, so reruns agree and rows can be drawn anywhere.

Targets are worked out in one task over a row for each source, and joined back by source (broadcast while they are few): fit
for thousands of sources, not for one source per page.  Null texts have size 0, null sources are one source (the last), a source
without words has rate 0; repeated rows and ids are drawn alike; an empty table gives an empty result.  Columns of the input called
``mix_size``, ``mix_source_size``, ``mix_target`` or ``mix_copies`` give way in ``with_copies`` and stay in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused

NAMES = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """Add ``target`` to ``source, source_size``: one row for each source.

    Sources by code point, null last, take ``weights`` in turn.  With caps c and weights w the targets
    are min(c, x w) for the one x at which they add up to all words: in ascending order of
    c / w, the capped sources are those before the first that x leaves below its cap.  The windows
    are over sources, which are far fewer than documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.hex(F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_copies)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.hex(F.col("source")))
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("source_size").over(whole), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open_weight": F.sum("weight").over(after)})
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight").cast("double"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed: 52 bits of a SHA-256."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(16**13)


def _drawn(docs: DataFrame, names: list[str], size: Column, id_col: str = "doc_id", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """``docs`` with size, source's size, target and copies under these names."""
    n, total, target, copies = names
    (other,) = unused(docs, "mix_source")
    sized = docs.withColumn(n, size)
    sizes = sized.groupBy("source").agg(F.sum(n).alias("source_size"))
    targets = source_targets(sizes, weights, most_copies).select(F.col("source").alias(other), F.col("source_size").alias(total), F.col("target").alias(target))
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col(other))).drop(other)
    rate = F.coalesce(F.try_divide(F.col(target), F.col(total)), F.lit(0.0))
    return rows.withColumn(copies, (F.floor(rate) + (draw(id_col, seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``; all rows stay."""
    return _drawn(docs.drop(*(c for c in docs.columns if c.lower() in NAMES)), list(NAMES), n_words(), **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Each document as many times as it is taken, with the columns of ``docs``."""
    names = unused(docs, *NAMES)
    rows = _drawn(docs, names, n_words(), **options).filter(F.col(names[-1]) > 0)
    (copy,) = unused(rows, "mix_copy")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[-1]).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query; texts are read once, their sizes kept in a table."""
    sized = cut(docs.select("doc_id", "source", n_words().alias("n")))
    rows = _drawn(sized, list(NAMES), F.col("n"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source IS NULL, hex(source)) - 1) % 3 AS weight FROM sizes),
summed AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, hex(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, hex(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed),
levels AS (SELECT *, (total - capped)::DOUBLE / open_weight::DOUBLE AS level FROM summed),
one AS (SELECT arg_min(level, cap::DOUBLE / weight) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap::DOUBLE, l.weight * one.level), 0.0)::DOUBLE AS target FROM levels l CROSS JOIN one),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
