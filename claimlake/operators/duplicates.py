"""Canonical posts: exact, near and image duplicates in arrival order."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, text_key
from ..plans.lineage import cut, spread
from .components import connected_components
from .relational import looked_up


def image_hash(path: Column | str) -> Column:
    """64 bits from a path's SHA-256."""
    return F.conv(F.substring(F.sha2(path, 256), 1, 16), 16, -10).cast("bigint")


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int = 3) -> Iterator[pa.RecordBatch]:
    """Each text's distinct character n-grams as sorted numbers, 21 bits for a character; a shorter text is its own only member."""
    for batch in batches:
        sizes, sets = [], []
        for text in batch.column("text").to_pylist():
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            c = c if len(c) >= n else np.concatenate([c, np.full(n - len(c), (1 << 21) - 1)])  # no character has this number
            grams = np.unique(sum(c[k : len(c) - n + 1 + k] << 21 * k for k in range(n)))
            sizes.append(len(grams))
            sets.append(grams.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("ordinal"), batch.column("fresh"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["ordinal", "fresh", "n", "grams"])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sets of one part in blocks of about ``most`` grams, with the part's number and what its sizes span."""
    part = TaskContext.get().partitionId()

    def block(rows: list[tuple[int, bool, int, bytes]]) -> pa.RecordBatch:
        ordinals, fresh, sizes, grams = zip(*rows, strict=True)
        values = [[part], [any(fresh)], [min(sizes)], [max(sizes)], [np.array(ordinals, np.int64).tobytes()], [np.array(sizes, np.int64).tobytes()], [b"".join(grams)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "fresh", "low", "high", "ordinals", "sizes", "grams"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("ordinal", "fresh", "n", "grams")), strict=True):
            if rows and (held + row[2] > most or len(rows) == 1024 or row[1] != rows[0][1]):
                yield block(rows)
                rows, held = [], 0
            rows.append(row)
            held += row[2]
    if rows:
        yield block(rows)


def _common(x: tuple, y: tuple, width: int = 8192) -> np.ndarray:
    """How many grams each set of one block shares with each of another: products over the grams that both blocks hold, ``width`` at a time."""
    both, at_x, at_y = np.intersect1d(x[2], y[2], assume_unique=True, return_indices=True)
    out = np.zeros((len(x[0]), len(y[0])))
    sides = []
    for (ordinals, sizes, known, place, _), at in ((x, at_x), (y, at_y)):
        column = np.full(len(known), -1)
        column[at] = np.arange(len(both))
        row, col = np.repeat(np.arange(len(ordinals)), sizes), column[place]
        order = np.argsort(col, kind="stable")
        sides.append((len(ordinals), row[order], col[order]))
    for first in range(0, len(both), width):
        dense = []
        for rows, row, col in sides:
            a, b = np.searchsorted(col, (first, first + width))
            part = np.zeros((rows, min(width, len(both) - first)), np.float32)
            part[row[a:b], col[a:b] - first] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T  # counts of at most ``width``, so exact
    return out


def _parities(sizes: np.ndarray, grams: np.ndarray, bits: int) -> np.ndarray:
    """For each set, by a hash of its grams: 1 where an even number of them falls, -1 where an odd number does.

    Two sets' parities differ at no more places than there are grams that only one of them has.
    """
    place = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (bits - 1)
    odd = np.bincount(np.repeat(np.arange(len(sizes)) * bits, sizes) + place, minlength=len(sizes) * bits) & 1
    return (1 - 2 * odd).astype(np.float32).reshape(len(sizes), bits)


def _folded(parities: np.ndarray, bits: int) -> np.ndarray:
    """The parities at fewer bits, a power of two: places that a shorter hash does not tell apart are one."""
    while parities.shape[1] > bits:
        half = parities.shape[1] // 2
        parities = parities[:, :half] * parities[:, half:]
    return parities


def _could_meet(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of sets whose sizes and parities let their similarity be at the threshold; exact in that none is left out that is.

    At a similarity of J, sets of n and m grams have (n + m) (1 - J) / (1 + J) grams that only one has.
    """
    bits = min(x.shape[1], y.shape[1])
    apart = (bits - _folded(x, bits) @ _folded(y, bits).T) / 2  # whole numbers of at most ``bits``, so exact
    both = (n[:, None] + m[None, :]).astype(np.float64)
    fits = np.minimum(n[:, None], m[None, :]) >= threshold * np.maximum(n[:, None], m[None, :]) - 1e-6
    return fits & (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-6)


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks of one part come first, then the other's; those of a part that meets itself come once and meet what came before."""
    held = []
    for batch in batches:
        for i in range(batch.num_rows):
            turn, fresh, ordinals, sizes, grams = (batch.column(c)[i].as_py() for c in ("turn", "fresh", "ordinals", "sizes", "grams"))
            ordinals, sizes, grams = (np.frombuffer(b, np.int64) for b in (ordinals, sizes, grams))
            bits = 1 << min(max(int(sizes.mean()), 512).bit_length() - 1, 13)  # over half as many as grams, so that different sets' parities differ; at most 32 KB a set
            new = (ordinals, sizes, grams, np.concatenate([[0], np.cumsum(sizes)]), _parities(sizes, grams, bits), fresh)
            if turn != 1:
                held.append(new)
            for old in held if turn else ():
                p, n, q, m = old[0], old[1], new[0], new[1]
                if not (fresh or old[5]) or min(n.max(), m.max()) < threshold * max(n.min(), m.min()):
                    continue
                could = _could_meet(old[4], n, new[4], m, threshold)
                could &= (p[:, None] < q[None, :]) if old is new else True
                x, y = np.nonzero(could)
                if not len(x):
                    continue
                score = _scores(old, new, x, y)
                some = score >= threshold
                x, y, score = x[some], y[some], score[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p[x], q[y])), pa.array(np.maximum(p[x], q[y])), pa.array(score)], names=["a", "b", "score"])


def _scores(old: tuple, new: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sets of two blocks: one by one where they are few, by products of the rows concerned where they are many."""
    (_, n, grams, at, *_), (_, m, others, to, *_) = old, new
    if len(x) <= 4 * (len(np.unique(x)) + len(np.unique(y))):
        common = np.array([len(np.intersect1d(grams[at[i] : at[i + 1]], others[to[j] : to[j + 1]], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.float64)
    else:
        sides = []
        for sizes, g, starts, rows in ((n, grams, at, np.unique(x)), (m, others, to, np.unique(y))):
            known, place = np.unique(np.concatenate([g[starts[i] : starts[i + 1]] for i in rows]), return_inverse=True)
            sides.append((rows, sizes[rows], known, place, None))
        common = _common(*sides)[np.searchsorted(sides[0][0], x), np.searchsorted(sides[1][0], y)]
    return common / (n[x] + m[y] - common)


def near_pairs(posts: DataFrame, threshold: float = 0.85, part_rows: int = 16_384, part_grams: int = 8_000_000, block_grams: int = 1_000_000) -> DataFrame:
    """``a, b, score`` (a before b) of texts whose character 3-gram sets have at least this Jaccard similarity; ``posts`` has ``ordinal, text``, ordinals are unique.

    Long texts of one language share most of their 3-grams, so no gram is rare enough to tell texts apart and a join on grams meets nearly all pairs
    one by one.  So sets are ordered by size and dealt in that order to parts, and parts whose sizes let sets be similar enough meet as
    pairs of parts, one in a task, block by block.  Products of short rows of parities tell which pairs cannot be similar enough; the numbers of
    common grams of the others are counted, so scores are exact and none is missed.  A task holds one part (about ``part_rows`` texts or
    ``part_grams`` grams) with its parities; the work is that of all pairs of like size, a few hundred or thousand products each.  Where ``posts`` has a column
    ``fresh``, only pairs with a fresh text are met.
    """
    fresh = F.col("fresh") if "fresh" in posts.columns else F.lit(True)
    bare = spread(posts.select(F.col("ordinal").cast("long").alias("ordinal"), fresh.alias("fresh"), collapse(F.lower("text")).alias("text")).filter("text <> ''"))
    sets = cut(bare.mapInArrow(_gram_sets, "ordinal long, fresh boolean, n long, grams binary"))
    rows, grams = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    least = min(int((4 * posts.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1, -(-rows // 256))  # several pairs of parts for each core
    parts = max(least, -(-rows // part_rows), -(-grams // part_grams), 1)
    dealt = sets.repartitionByRange(parts, "fresh", "n", "ordinal").sortWithinPartitions("fresh", "n", "ordinal")
    blocks = cut(dealt.mapInArrow(functools.partial(_blocks, most=block_grams), "part int, fresh boolean, low long, high long, ordinals binary, sizes binary, grams binary"))
    spans = blocks.groupBy("part").agg(F.max("fresh").alias("fresh"), F.min("low").alias("low"), F.max("high").alias("high"))
    x, y = (spans.select(*(F.col(c).alias(f"{c}_{k}") for c in spans.columns)) for k in "xy")
    fits = (F.col("part_x") <= F.col("part_y")) & (F.col("fresh_x") | F.col("fresh_y")) & (F.least("high_x", "high_y") >= threshold * F.greatest("low_x", "low_y"))
    meetings = cut(x.join(y, fits).select("part_x", "part_y", (F.row_number().over(Window.orderBy("part_x", "part_y")) - 1).alias("place")))  # rows for parts, not for texts
    turns = meetings.select(F.col("part_x").alias("part"), "place", F.when(F.col("part_x") == F.col("part_y"), 2).otherwise(0).alias("turn"))
    turns = turns.unionByName(meetings.filter("part_x < part_y").select(F.col("part_y").alias("part"), "place", F.lit(1).alias("turn")))
    sent = blocks.select("part", "fresh", "ordinals", "sizes", "grams").join(F.broadcast(turns), "part")
    met = sent.repartitionById(max(meetings.count(), 1), F.col("place")).sortWithinPartitions("turn").select("turn", "fresh", "ordinals", "sizes", "grams")
    return met.mapInArrow(functools.partial(_meet, threshold=threshold), "a long, b long, score double")


def near_hashes(hashes: DataFrame, most: int = 5) -> DataFrame:
    """``g, h, distance`` (g before h) of different values of ``image_hash`` at most ``most`` bits apart: they share one of ``most + 1`` slices."""
    width = -(-64 // (most + 1))
    rows = hashes.filter("image_hash is not null").select("image_hash").distinct()
    sliced = rows.select("image_hash", F.posexplode(F.array(*(F.shiftrightunsigned("image_hash", i * width).bitwiseAND((1 << min(width, 64 - i * width)) - 1) for i in range(most + 1)))).alias("slice", "bits"))
    x, y = (sliced.select("slice", "bits", F.col("image_hash").alias(k)) for k in "gh")
    pairs = x.join(y, ["slice", "bits"]).filter("g < h").withColumn("distance", F.bit_count(F.col("g").bitwiseXOR(F.col("h"))))
    return pairs.filter(F.col("distance") <= most).select("g", "h", "distance").distinct()


def image_pairs(posts: DataFrame, most: int = 5) -> DataFrame:
    """``a, b, distance`` (a before b) of the first rows of different image hashes at most ``most`` bits apart.

    Rows with equal hashes are one here, so a common picture makes no pairs; ``image_copies`` tells which rows a first row stands for,
    ``image_classes`` which rows belong together.
    """
    firsts = posts.filter("image_hash is not null").groupBy("image_hash").agg(F.min("ordinal").alias("first"))
    x, y = (firsts.select(F.col("image_hash").alias(c), F.col("first").alias(k)) for c, k in (("g", "p"), ("h", "q")))
    return near_hashes(posts, most).join(x, "g").join(y, "h").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def image_copies(posts: DataFrame) -> DataFrame:
    """``a, b, distance`` of the first row of each image hash (a) and each other row that has it (b), at distance 0.

    With ``image_pairs`` these tell all pairs of rows: those with one first row, and those whose first rows are a pair.
    """
    rows = cut(posts.filter("image_hash is not null").select(F.col("ordinal").alias("b"), "image_hash"))
    firsts = cut(rows.groupBy("image_hash").agg(F.min("b").alias("a")))
    return looked_up(rows, firsts, "image_hash").filter("a <> b").select("a", "b", F.lit(0).alias("distance"))


def image_classes(posts: DataFrame, most: int = 5) -> DataFrame:
    """``ordinal, class, links`` of each row with an image hash: its class is named by the smallest ordinal that near hashes lead to.

    ``links`` counts the other rows at most ``most`` bits away.  Classes and counts come from distinct hashes and how many rows have each, so
    neither a common picture nor a large family is paired up by rows.
    """
    rows = posts.filter("image_hash is not null")
    counts = cut(rows.groupBy("image_hash").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")))
    near = cut(near_hashes(posts, most))
    both = near.select(F.col("g").alias("image_hash"), F.col("h").alias("other")).unionByName(near.select(F.col("h").alias("image_hash"), F.col("g").alias("other")))
    met = both.join(counts.select(F.col("image_hash").alias("other"), F.col("n").alias("there")), "other").groupBy("image_hash").agg(F.sum("there").alias("there"))
    joined = connected_components(near, "g", "h").select(F.col("id").alias("image_hash"), "component")
    known = counts.join(joined, "image_hash", "left").join(met, "image_hash", "left").withColumn("component", F.coalesce("component", "image_hash"))
    named = known.groupBy("component").agg(F.min("first").alias("class"))
    out = cut(known.join(named, "component").select("image_hash", "class", (F.col("n") - 1 + F.coalesce("there", F.lit(0))).alias("links")))
    return looked_up(cut(rows.select("ordinal", "image_hash")), out, "image_hash").select("ordinal", "class", "links")


def _nearest(state: DataFrame, key: str, near: DataFrame, measure: str) -> DataFrame:
    """For each value of ``key``: the first canonical (``found``: ordinal, measure) and the first undecided row among near values."""
    firsts = state.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(F.col("canonical"), F.col("ordinal"))).alias("c"), F.min(F.when(F.col("canonical").isNull(), F.col("ordinal"))).alias("u"))
    met = near.join(firsts.withColumnRenamed(key, "other"), "other")
    return met.groupBy(key).agg(F.min(F.when(F.col("c").isNotNull(), F.struct("c", measure))).alias("found"), F.min("u").alias("open"))


def canonicalise(posts: DataFrame, threshold: float = 0.85, most: int = 5) -> DataFrame:
    """``ordinal, duplicate_of, kind, score`` of each post, as if posts were met one after the other.

    A post is a duplicate of the first earlier canonical one with the same text (EXACT), with a near
    text (TEXT), or with a near image (IMAGE); else it is canonical.  Whether a post is canonical follows from
    earlier ones alone, so each round decides all posts whose earlier neighbours are decided or
    of which one is canonical; rounds grow with the longest chain of undecided neighbours.

    Rows with one text and one image are one from the start, as only the first of them can be canonical.  Texts and images are
    compared once each, and what is known of their rows passes between them as minima, so no pairs of rows are made: a group
    of copies or a common image is a single value.  ``posts`` has ``ordinal, text, image_hash``; null texts are empty.  A column ``fresh``
    tells rows that are known to be canonical, all before the others, from those that are not yet met; known texts are not compared again.
    """
    has = "fresh" in posts.columns
    rows = cut(posts.select("ordinal", F.coalesce("text", F.lit("")).alias("text"), text_key(F.coalesce("text", F.lit(""))).alias("key"), "image_hash", *(["fresh"] if has else [])))
    texts = rows.groupBy("key").agg(F.min("ordinal").alias("id"), F.min_by("text", "ordinal").alias("text"), *([F.bool_and("fresh").alias("fresh")] if has else []))
    keyed = cut(rows.select("ordinal", "key", "image_hash").join(texts.select("key", "id"), "key").drop("key"))
    pairs = cut(near_pairs(texts.select(F.col("id").alias("ordinal"), "text", *(["fresh"] if has else [])), threshold).select("a", "b", F.round("score", 4).alias("score")))
    near_texts = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    hashes = cut(near_hashes(keyed, most))
    same = keyed.filter("image_hash is not null").select("image_hash", F.col("image_hash").alias("other"), F.lit(0).alias("distance")).distinct()
    near_images = hashes.select(F.col("g").alias("image_hash"), F.col("h").alias("other"), "distance").unionByName(hashes.select(F.col("h").alias("image_hash"), F.col("g").alias("other"), "distance")).unionByName(same)

    def met(state: DataFrame, of: DataFrame) -> DataFrame:
        """``of`` with the first canonical rows of the same text, near texts and near images, and the first open row of all these."""
        own = state.groupBy("id").agg(F.min(F.when(F.col("canonical"), F.col("ordinal"))).alias("exact"), F.min(F.when(F.col("canonical").isNull(), F.col("ordinal"))).alias("open_own"))
        text = _nearest(state, "id", near_texts, "score").withColumnsRenamed({"found": "text", "open": "open_text"})
        image = _nearest(state, "image_hash", near_images, "distance").withColumnsRenamed({"found": "image", "open": "open_image"})
        return of.join(own, "id").join(text, "id", "left").join(image, "image_hash", "left").withColumn("open", F.least("open_own", "open_text", "open_image"))

    before = lambda c: F.coalesce(F.col(c) < F.col("ordinal"), F.lit(False))
    hit = before("exact") | before("text.c") | before("image.c")
    state = cut(keyed.groupBy("id", "image_hash").agg(F.min("ordinal").alias("ordinal")).withColumn("canonical", F.lit(None).cast("boolean")))
    while not state.filter("canonical is null").isEmpty():
        new = F.when(hit, False).when(F.coalesce(F.col("open") >= F.col("ordinal"), F.lit(True)), True)
        state = cut(met(state, state).select("id", "image_hash", "ordinal", F.coalesce("canonical", new).alias("canonical")))
    out = met(state, keyed)
    kind = F.when(before("exact"), "EXACT").when(before("text.c"), "TEXT").when(before("image.c"), "IMAGE")
    of = F.when(kind == "EXACT", F.col("exact")).when(kind == "TEXT", F.col("text.c")).when(kind == "IMAGE", F.col("image.c"))
    score = F.when(kind == "EXACT", 1.0).when(kind == "TEXT", F.col("text.score")).when(kind == "IMAGE", F.round(1 - F.col("image.distance") / 64, 4))
    return out.select("ordinal", of.alias("duplicate_of"), kind.alias("kind"), score.alias("score"))
