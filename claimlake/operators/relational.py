"""Joins, aggregates and order-dependent operators over posts, claims, evidence and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).filter("_at = 1").drop("_at")


def inherit(children: DataFrame, parents: DataFrame, key: str, column: str, default: str | None = None) -> DataFrame:
    """``column`` of the parent, or ``default``; children without a parent stay."""
    out = children.join(parents.select(key, column), key, "left")
    return out if default is None else out.withColumn(column, F.coalesce(column, F.lit(default)))


def broken_references(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def members(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_semi")


def distributions(df: DataFrame, keys: list[str]) -> DataFrame:
    """``dimension, value, n`` for several keys in one pass."""
    cube = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("x.*")
    return cube.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` of ``column`` for each ``row``, 0 where there are none."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v.lower()) for v in values))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return out.filter(F.size("splits") > 1)


def duplicates(df: DataFrame, key: str, text_key: str) -> DataFrame:
    """How many ids and texts repeat: one row."""
    return df.agg((F.count("*") - F.count_distinct(key)).alias("duplicate_ids"), (F.count("*") - F.count_distinct(text_key)).alias("duplicate_texts"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, low, high, mean, middle, spread, constant, near_constant`` for each column; the middle is exact.

    Moments come from one pass over all columns.  The middle comes from each column's distinct values with counts: they are sorted in
    ranges and counted up, so no task sees a whole column.
    """
    one = df.agg(*(F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread"), F.count(c).alias("n")).alias(c) for c in columns))
    out = one.select(F.explode(F.array(*columns)).alias("x")).select("x.*")
    middles = None
    for c in columns:
        counts = running_totals(df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("k")), "v", {"k": "before"})
        n = out.filter(F.col("feature") == c).select(F.col("n").alias("all"))
        rows = counts.join(F.broadcast(n))  # one row
        inside = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("k"))
        low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
        middle = rows.agg(((F.max(F.when(inside(low), F.col("v"))) + F.max(F.when(inside(high), F.col("v")))) / 2).alias("middle")).withColumn("feature", F.lit(c))
        middles = middle if middles is None else middles.unionByName(middle)
    out = out.join(F.broadcast(middles), "feature")  # one row for each column
    return out.select("feature", "low", "high", "mean", "middle", "spread", (F.col("low") == F.col("high")).alias("constant"), (F.col("spread") < 1e-4).alias("near_constant"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of each pair of columns; null where one is constant."""
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            spread = F.stddev_pop(a) * F.stddev_pop(b)
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(spread > 0, F.covar_pop(a, b) / spread).alias("r")))
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column (null, NaN, infinite, or UNKNOWN / NONE in either case)."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        if types[c] in ("double", "float"):
            return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        if types[c] == "string":
            return F.col(c).isNull() | F.col(c).isin("UNKNOWN", "unknown", "NONE", "none")
        return F.col(c).isNull()

    one = df.agg(F.count("*").alias("n"), *(F.count_if(missing(c)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing"), "n") for c in columns))).alias("x")).select("x.*").withColumn("share", F.when(F.col("n") > 0, F.round(F.col("missing") / F.col("n"), 4)).otherwise(0.0))


def carry_forward(df: DataFrame, group: str, order: list[str], column: str, out: str) -> DataFrame:
    """The last non-null value of ``column`` so far."""
    so_far = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(so_far))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in the order of a column whose values are unique.

    Rows are sorted in ranges; the rows of the ranges before are summed over one row for each range, so no task sees all.
    """
    from ..plans.lineage import cut

    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row for each range
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")


def running_totals(df: DataFrame, order: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with sums of columns over the rows before each in the order of ``order``, whose values are unique.

    Like ``numbered``: sums inside ranges, and the totals of the ranges before from one row for each range.
    """
    from ..plans.lineage import cut

    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), "_part")
    return out.withColumns({name: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in columns.items()}).drop("_part", *(f"_{c}" for c in columns))


def upper_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, upper_median``: the element at place n // 2 (from 0) of each group's sorted values, from counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(group))})
    return rows.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(group).agg(F.min(value).alias("upper_median"))


def ratio_split(groups: DataFrame, key: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``key, split``: sorted keys cut at floor(n * train) and floor(n * validation)."""
    rows = numbered(groups.select(key).distinct(), key, "_at")
    total = rows.agg(F.count("*").alias("_n"))
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    return rows.join(F.broadcast(total)).select(key, F.when(F.col("_at") <= first, "train").when(F.col("_at") <= first + second, "validation").otherwise("test").alias("split"))


def greedy_split(sizes: DataFrame, key: str = "cluster", size: str = "size", synthetic: str = "synthetic", test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """``key, split``: whole clusters, largest first and then by key, fill test, then validation; the rest train.

    Test takes no synthetic cluster.  A cluster that would overfill a split is passed over, unless the split is empty.  Of clusters
    of one size a split takes the first so many by key, so the fold is over the distinct sizes, of which a corpus of n
    posts has at most the square root of 2 n, and each cluster is then compared with its size's share.
    """
    rows = sizes.select(F.col(key).alias("_key"), F.col(size).alias("_size"), F.col(synthetic).alias("_synthetic"))
    total = rows.agg(F.sum("_size")).first()[0] or 0

    def takes(share: float, of: DataFrame) -> dict[int, int]:
        goal, filled, out = math.floor(total * share), 0, {}
        for r in of.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect():  # one row for each distinct size
            if filled >= goal:
                break
            k = min(r.n, max(0, (goal - filled) // r["_size"]) or (1 if filled == 0 else 0))
            if k:
                out[r["_size"]] = k
                filled += k * r["_size"]
        return out

    def marked(of: DataFrame, counts: dict[int, int], name: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("_size").orderBy("_key"))
        most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("_size")), F.lit(0)) if counts else F.lit(0)
        return of.filter(F.col("_size").isin(list(counts))).withColumn("_at", at).filter(F.col("_at") <= most).select("_key", F.lit(name).alias("_split"))

    first = marked(rows.filter(~F.col("_synthetic")), takes(test, rows.filter(~F.col("_synthetic"))), "test")
    left = rows.join(first, "_key", "left_anti")
    second = marked(left, takes(validation, left), "validation")
    return rows.join(first.unionByName(second), "_key", "left").select(F.col("_key").alias(key), F.coalesce("_split", F.lit("train")).alias("split"))


def agreement(submissions: DataFrame, task: str, label: str) -> DataFrame:
    """``status`` of each task: one label of several submissions is consensus."""
    out = submissions.groupBy(task).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    return out.withColumn("status", F.when(F.col("n") < 2, "SINGLE_ANNOTATOR").when(F.col("labels") == 1, "CONSENSUS").otherwise("CONFLICT"))


def upper_median(values: Column) -> Column:
    """The element at place n // 2 of the sorted values."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


MOST_HEAVY = 100_000


def heavy(counts: DataFrame, n: str, least: int) -> DataFrame:
    """The rows of ``counts`` whose ``n`` is over ``least`` and over a ``MOST_HEAVY``-th of all, with ``copies``: tasks that each take so many at most.

    There are no more than ``MOST_HEAVY`` such rows, so they may be broadcast, whatever the input.
    """
    each = max(least, (counts.agg(F.sum(n)).head()[0] or 0) // MOST_HEAVY)
    return counts.filter(F.col(n) > each).withColumn("copies", F.ceil(F.col(n) / each).cast("long"))


def looked_up(rows: DataFrame, known: DataFrame, key: str, least: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``known``, one row for each key, nulls where there is none; ``rows`` is read three times, so it is a table.

    Keys that many rows have are looked up by a broadcast of just these, so no task has all rows of a key.
    """
    many = F.broadcast(heavy(rows.groupBy(key).agg(F.count("*").alias("n")), "n", least).select(key))
    hot = rows.join(many, key, "left_semi").join(F.broadcast(known.join(many, key, "left_semi")), key, "left")
    return hot.unionByName(rows.join(many, key, "left_anti").join(known, key, "left"))


def sketched(df: DataFrame, keys: list[str], version: str, size: int = 12) -> DataFrame:
    """``version, key, sketch, exact`` of the distinct values of each key: a theta sketch of 2^``size`` entries to be kept beside a manifest.

    A count from a sketch is exact while the values are fewer than its entries; beyond, one standard error is 2^(-``size`` / 2) of it.
    """
    one = df.agg(*(F.struct(F.theta_sketch_agg(F.col(k).cast("string"), size).alias("sketch"), F.count_distinct(k).alias("exact")).alias(k) for k in keys))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k)["sketch"].alias("sketch"), F.col(k)["exact"].alias("exact")) for k in keys))).alias("x")
    return one.select(rows).select(F.lit(version).alias("version"), "x.*")


def compared_versions(sketches: DataFrame, old: str, new: str) -> DataFrame:
    """``key, old, new, together, added, removed``: distinct values of two versions from their stored sketches alone."""
    a, b = (sketches.filter(F.col("version") == v).select("key", F.col("sketch").alias(k)) for v, k in ((old, "a"), (new, "b")))
    n = F.theta_sketch_estimate
    return a.join(b, "key").select("key", n("a").alias("old"), n("b").alias("new"), n(F.theta_union("a", "b")).alias("together"), n(F.theta_difference("b", "a")).alias("added"), n(F.theta_difference("a", "b")).alias("removed"))
