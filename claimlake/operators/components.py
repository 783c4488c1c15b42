"""Connected components by contraction to smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .relational import looked_up


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` (never larger than ``id``) to its end, twice as far each round; ids that have reached a root stay out of later rounds."""
    parents = cut(parents)
    ended, going = parents.filter("id = parent"), parents.filter("id <> parent")
    while not going.isEmpty():
        up = ended.unionByName(going).select(F.col("id").alias("parent"), F.col("parent").alias("up"))
        jumped = cut(looked_up(going, up, "parent"))
        ended = ended.unionByName(jumped.filter("up = parent").select("id", "parent"))
        going = jumped.filter("up < parent").select("id", F.col("up").alias("parent"))
    return ended


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every id on an edge; a component is named by its smallest id.

    Each round joins every id to its smallest neighbour and contracts the trees so made, so
    the number of edges at least halves with the ids; rounds grow with the logarithm of the
    longest path.  Null ends and self-loops are left out.  The ids of a large star are looked up by a broadcast of its centre (``looked_up``).
    """
    edges = cut(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("near")))
        roots = _roots(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("parent")))
        if found is None:
            found = roots.select("id", F.col("parent").alias("component"))
        else:
            merged = roots.select(F.col("id").alias("component"), "parent")
            found = cut(looked_up(found, merged, "component").select("id", F.coalesce("parent", "component").alias("component")))
        a, b = (roots.select(F.col("id").alias(c), F.col("parent").alias(f"root_{c}")) for c in "ab")
        ends = looked_up(cut(looked_up(edges, a, "a")), b, "b").select("root_a", "root_b").filter("root_a <> root_b")
        edges = cut(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
