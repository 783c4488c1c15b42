"""Hard negatives by score windows, with bounds along spanning trees of anchors.

An anchor's positives are its best rows of the same label; each positive's negatives are the best rows of other labels whose scores lie
in a window below the positive's.  Scores are inner products of integer vectors, exact.  |<a, v> - <b, v>| <= |a - b| |v|, so
from a row's score at a parent anchor, plus or minus the edge's length times the row's norm, follows where its score at a child
can lie; where the parent's score itself was only bounded, its bounds are widened.  Only rows whose bounds meet the window that is still open are scored.

Anchors go to the nearest of a few pivot anchors (one for ``block_anchors``, ``MOST_PIVOTS`` of each vector length at most: the pivots and one
row for each are all that the driver sees) and a pivot's anchors to blocks, each with a minimum spanning tree rooted at the pivot.
Rows travel in packs to the blocks that the same inequality, from the pivot's score and the pivot's farthest anchor, leaves in
question; a block that many rows visit is copied for every ``task_rows`` of them.  So anchors x rows are met in blocks, no key gathers its rows, and only
the best few rows of each anchor and copy leave a task.  Positives start from the best anchors of the same label and block, which are rows too.

Rows with a null label or a null vector, or with null or non-finite components, take no part; vectors meet those of their own length.
Rows that repeat, or share an id, are candidates each, though not for anchors of that id; equal anchors are answered once, anchors of
one id that differ are answered each.  Ties go to smaller ids, null ids (and 2^63 - 1, which stands for null here) last.  An anchor
without positives, or with negative scores only (whose window is empty), has no rows.  Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .whitening import largest, matrices, quantised

MOST_PIVOTS = 4096
_NO_ID = np.iinfo(np.int64).max
_NO_SCORE = -np.iinfo(np.int64).max  # its negative fits
_WIDER = 1e-9  # by which lengths and norms are taken larger than they are, above all errors of rounding


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``id, label, x, size`` of the rows that take part."""
    rows = vectors.filter(F.col(label_col).isNotNull())
    x = quantised(rows, vector_col, F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"))
    return x.withColumn("size", F.size("x"))


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``a`` (a vector or a matrix of columns), exact."""
    most = largest(x) * largest(a) * max(1, x.shape[1])
    if most < 2**53:  # all partial sums are integers that doubles hold
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return x @ a
    out = x.astype(object) @ a.astype(object)
    if out.size and max(map(abs, out.ravel())) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return out.astype(np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of the rows, a little larger than they are."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + _WIDER)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from row 0: rows in an order where parents come first, each one's parent, and the length to it."""
    full = vectors.astype(np.float64)
    n = len(full)
    parent, edge, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    order = np.zeros(n, np.int64)
    for k in range(n):
        new = int(np.where(open_, edge, np.inf).argmin()) if k else 0
        order[k], open_[new] = new, False
        away = np.sqrt(((full - full[new]) ** 2).sum(axis=1))
        closer = open_ & (away < edge)
        parent[closer], edge[closer] = new, away[closer]
    edge[0] = 0
    return order, parent, edge * (1 + _WIDER)


class Best:
    """The best k of each list: scores and ids, best first."""

    def __init__(self, lists: int, k: int):
        self.score, self.id = np.full((lists, k), _NO_SCORE), np.full((lists, k), _NO_ID)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        some = score >= self.score[at, -1]
        if some.any():
            s, i = np.concatenate([self.score[at], score[some]]), np.concatenate([self.id[at], ids[some]])
            top = np.lexsort((i, -s))[:k] if len(s) < 4 * k else self._top(s, i, k)
            self.score[at], self.id[at] = s[top], i[top]

    @staticmethod
    def _top(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
        some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return some[np.lexsort((i[some], -s[some]))[:k]]


@dataclass
class Block:
    """Anchors with their spanning tree; row 0 of ``vectors`` is the pivot, anchor i is row i + 1."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    edge: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, pivot: np.ndarray) -> Block:
        vectors = np.concatenate([pivot[None], x])
        return Block(ids, labels, vectors, *spanning_tree(vectors))

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        np.savez(sink, **vars(self))
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(data: bytes) -> Block:
        with np.load(pa.BufferReader(data)) as parts:
            return Block(**{name: parts[name] for name in parts})

    def floors(self, k: int) -> np.ndarray:
        """The k-th best score of each anchor among the block's other anchors of its label: its k best rows have no less."""
        out = np.full(len(self.ids), _NO_SCORE)
        for label in np.unique(self.labels):
            own = np.flatnonzero(self.labels == label)
            s = scores(self.vectors[own + 1], np.ascontiguousarray(self.vectors[own + 1].T))
            s[self.ids[own][:, None] == self.ids[own][None, :]] = _NO_SCORE
            if len(own) > k:
                out[own] = np.partition(s, len(own) - k, axis=1)[:, len(own) - k]
        return out

    def walk(self, x: np.ndarray, window, meet) -> int:  # noqa: ANN001
        """Score the rows that may lie in an anchor's window, anchor by anchor down the tree.

        ``window(anchor)`` gives the rows in question and the bounds of scores, or None; ``meet(anchor, rows, scores)`` takes what was scored.
        Returns how many scores were computed.
        """
        norms = lengths(x)
        slack = 1e-12 * norms * lengths(self.vectors).max()
        exact = scores(x, self.vectors[0])
        low, high = np.empty((2, len(self.vectors), len(x)))
        low[0], high[0] = exact - slack, exact + slack
        work = len(x)
        for at in self.order[1:]:
            reach = self.edge[at] * norms + slack
            low[at], high[at] = low[self.parent[at]] - reach, high[self.parent[at]] + reach
            open_ = window(at - 1)
            if open_ is None:
                continue
            asked, least, most = open_
            rows = np.flatnonzero(asked & (high[at] >= least) & (low[at] <= most))
            if len(rows):
                exact = scores(x[rows] if len(rows) < len(x) else x, self.vectors[at])
                low[at, rows], high[at, rows] = exact - slack[rows], exact + slack[rows]
                work += len(rows)
                meet(at - 1, rows, exact)
        return work


class Positives:
    """The best rows of each anchor's own label."""

    lists = 1

    def __init__(self, block: Block, k: int, windows: None = None):
        self.block, self.best, self.floor = block, Best(len(block.ids), k), block.floors(k)

    def pack(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        b, best = self.block, self.best

        def window(at: int) -> tuple:
            return (labels == b.labels[at]) & (ids != b.ids[at]), max(best.score[at, -1], self.floor[at]), np.inf

        return b.walk(x, window, lambda at, rows, s: best.add(at, s, ids[rows]))


class Negatives:
    """The best rows of other labels in the window of each positive of each anchor; ``windows``: lowest and highest score of anchor and positive."""

    def __init__(self, block: Block, k: int, windows: np.ndarray):
        self.block, self.windows, self.lists = block, windows, windows.shape[1]
        self.best = Best(len(block.ids) * self.lists, k)

    def pack(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        b, best, m = self.block, self.best, self.lists

        def window(at: int) -> tuple | None:
            low, high = self.windows[at].T
            some = low <= high
            if not some.any():
                return None
            still = np.maximum(low, best.score[at * m : (at + 1) * m, -1])
            return (labels != b.labels[at]) & (ids != b.ids[at]), still[some].min(), high[some].max()

        def meet(at: int, rows: np.ndarray, s: np.ndarray) -> None:
            for i, (low, high) in enumerate(self.windows[at]):
                inside = (s >= low) & (s <= high)
                if inside.any():
                    best.add(at * m + i, s[inside], ids[rows[inside]])

        return b.walk(x, window, meet)


KEY = ["size", "pivot", "part"]
_BLOCK = "size int, pivot long, part long, anchors long, away double, floor long, block binary"


def _nearest(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Anchors with their nearest pivot."""
    for batch in batches:
        for rows, x in matrices(batch.column("x")):
            p, full = pivots[x.shape[1]].astype(np.float64), x.astype(np.float64)
            at = ((p * p).sum(axis=1)[None, :] - 2 * full @ p.T).argmin(axis=1)
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "pivot"])


def _build(table: pa.Table, pivots: dict[int, np.ndarray], k: int) -> pa.Table:
    size, pivot, part = (table.column(c)[0].as_py() for c in KEY)
    ((_, x),) = matrices(table.column("x").combine_chunks())
    block = Block.build(table.column("id").to_numpy(), table.column("label").to_numpy(), x, pivots[size][pivot])
    away = lengths(x - pivots[size][pivot]).max()
    return pa.table({"size": pa.array([size], pa.int32()), "pivot": [pivot], "part": [part], "anchors": [len(x)], "away": [float(away)], "floor": [int(block.floors(k).min())], "block": pa.array([block.dump()], pa.binary())})


@dataclass
class Reach:
    """Of the pivots of one vector length: their vectors, parts, farthest anchors, and the window of scores in question."""

    vectors: np.ndarray
    parts: np.ndarray
    away: np.ndarray
    low: np.ndarray
    high: np.ndarray


def blocks_of(anchors: DataFrame, block_anchors: int, k: int) -> tuple[DataFrame, dict[int, Reach]]:
    """Blocks of anchors as a table, and what the driver knows of each pivot."""
    counted = {r["size"]: r["n"] for r in anchors.groupBy("size").agg(F.count("*").alias("n")).collect()}
    wanted = {s: min(MOST_PIVOTS, -(-n // block_anchors)) for s, n in counted.items()}
    of = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) if m else F.create_map().cast("map<int,bigint>"), F.col("size"))
    below = {s: int(-(2**63) + min(1.0, 4 * (wanted[s] + 16) / n) * (2**64 - 2048)) for s, n in counted.items()}  # leaves four times as many as are wanted, on the mean
    at = F.row_number().over(Window.partitionBy("size").orderBy("h", "id", "x"))
    some = anchors.withColumn("h", F.xxhash64("id")).filter(F.col("h") <= of(below)).withColumn("at", at).filter(F.col("at") <= of(wanted))
    picked: dict[int, list] = {}
    for r in some.orderBy("size", "at").select("size", "x").toLocalIterator():
        picked.setdefault(r["size"], []).append(r["x"])
    pivots = {s: np.array(v, np.int64).reshape(len(v), s) for s, v in picked.items()}
    dealt = cut(anchors.select("id", "label", "x", "size").mapInArrow(functools.partial(_nearest, pivots=pivots), "id long, label long, x array<long>, size int, pivot long"))
    parts = dealt.groupBy("size", "pivot").agg(F.ceil(F.count("*") / block_anchors).cast("long").alias("parts"))  # one row for each pivot
    rows = dealt.join(F.broadcast(parts), ["size", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    build = functools.partial(_build, pivots=pivots, k=k)
    blocks = cut(rows.select(*KEY, "id", "label", "x").groupBy(*KEY).applyInArrow(lambda t: build(t), _BLOCK))
    known = {s: Reach(p, *np.zeros((1, len(p)), np.int64), *np.full((3, len(p)), 0.0)) for s, p in pivots.items()}
    for r in blocks.groupBy("size", "pivot").agg((F.max("part") + 1).alias("parts"), F.max("away").alias("away"), F.min("floor").alias("low")).collect():
        reach = known[r["size"]]
        reach.parts[r.pivot], reach.away[r.pivot], reach.low[r.pivot], reach.high[r.pivot] = r.parts, r.away, r.low, np.inf
    return blocks, known


_PACK = "size int, pivot long, part long, n long, ids binary, labels binary, x binary"


def _route(batches: Iterator[pa.RecordBatch], known: dict[int, Reach]) -> Iterator[pa.RecordBatch]:
    """Packs of rows for the blocks that they have to visit."""
    for batch in batches:
        for rows, x in matrices(batch.column("x")):
            reach = known.get(x.shape[1])
            if reach is None:
                continue
            ids, labels = batch.column("id").to_numpy()[rows], batch.column("label").to_numpy()[rows]
            s = x.astype(np.float64) @ reach.vectors.astype(np.float64).T
            span = lengths(x)[:, None] * (reach.away + 1e-9 * lengths(reach.vectors))[None, :]
            goes = (reach.parts > 0) & (s + span >= reach.low) & (s - span <= reach.high)
            narrow = x.astype(np.min_scalar_type(-largest(x) - 1))  # the narrowest integers that hold them
            for p in np.flatnonzero(goes.any(axis=0)).tolist():
                w = np.flatnonzero(goes[:, p])
                parts = int(reach.parts[p])
                pack = [x.shape[1]] * parts, [p] * parts, range(parts), [len(w)] * parts, [ids[w].tobytes()] * parts, [labels[w].tobytes()] * parts, [narrow.dtype.char.encode() + narrow[w].tobytes()] * parts
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(pack, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["size", "pivot", "part", "n", "ids", "labels", "x"])


_FOUND = "size int, pivot long, part long, at long, list long, anchor_id long, id long, score long"


def _search(batches: Iterator[pa.RecordBatch], kind: type, k: int) -> Iterator[pa.RecordBatch]:
    """A block comes first, then the packs that visit it; the best of each list leave when the next block comes."""
    state, key = None, None

    def leave() -> pa.RecordBatch:
        best = state.best
        at, col = np.nonzero(best.score != _NO_SCORE)
        n, m = len(at), state.lists
        columns = [pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int64()), pa.array([key[2]] * n, pa.int64()), pa.array(at // m), pa.array(at % m), pa.array(state.block.ids[at // m]), pa.array(best.id[at, col]), pa.array(best.score[at, col])]
        return pa.RecordBatch.from_arrays(columns, names=["size", "pivot", "part", "at", "list", "anchor_id", "id", "score"])

    for batch in batches:
        blocks, windows, ids, labels, xs = (batch.column(c) for c in ("block", "windows", "ids", "labels", "x"))
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*KEY, "copy"))))
        for i in range(batch.num_rows):
            if blocks[i].is_valid:
                if state:
                    yield leave()
                block, key = Block.load(blocks[i].as_py()), keys[i]
                state = kind(block, k, _windows(windows[i].as_py(), len(block.ids)))
            elif key == keys[i]:
                data = xs[i].as_py()
                x = np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).astype(np.int64).reshape(-1, key[0]) if key[0] else np.zeros((len(ids[i].as_py()) // 8, 0), np.int64)
                state.pack(np.frombuffer(ids[i].as_py(), np.int64), np.frombuffer(labels[i].as_py(), np.int64), x)
    if state:
        yield leave()


def _windows(known: list[dict] | None, anchors: int) -> np.ndarray:
    """Lowest and highest score by anchor and positive; empty where there is none."""
    out = np.zeros((anchors, max((w["list"] for w in known or ()), default=0) + 1, 2), np.int64)
    out[:, :, 0] = 1
    for w in known or ():
        out[w["at"], w["list"]] = w["low"], w["high"]
    return out


def _visit(blocks: DataFrame, rows: DataFrame, known: dict[int, Reach], kind: type, k: int, task_rows: int) -> DataFrame:
    """``_FOUND`` of the best k rows of each list, in each copy of a block."""
    packs = cut(rows.select("id", "label", "x").mapInArrow(functools.partial(_route, known=known), _PACK))
    loads = packs.groupBy(*KEY).agg(F.ceil(F.sum("n") / task_rows).cast("long").alias("copies"))
    none = F.lit(None).cast("binary")
    windows = F.col("windows")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    first = blocks.join(loads, KEY).select(*KEY, copies, F.lit(0).alias("turn"), "block", windows, none.alias("ids"), none.alias("labels"), none.alias("x"))
    then = packs.join(loads, KEY).select(*KEY, F.pmod(F.xxhash64("ids"), "copies").alias("copy"), F.lit(1).alias("turn"), none.alias("block"), F.lit(None).cast(blocks.schema["windows"].dataType).alias("windows"), "ids", "labels", "x")
    dealt = first.unionByName(then).repartition(*KEY, "copy").sortWithinPartitions(*KEY, "copy", "turn")
    return dealt.mapInArrow(functools.partial(_search, kind=kind, k=k), _FOUND)


_LISTS = "array<struct<at:bigint,list:bigint,low:bigint,high:bigint>>"


def _ranked(found: DataFrame, k: int, *key: str) -> DataFrame:
    best = Window.partitionBy(*KEY, *key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int, int] = (80, 100, 100), block_anchors: int = 256, task_rows: int = 65_536) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over rows of ``usable``.

    ``window`` is low, high, den: low * positive_score <= den * negative_score <= high * positive_score.
    """
    low, high, den = window
    blocks, known = blocks_of(rows.filter(is_anchor).dropDuplicates(["id", "label", "x"]), block_anchors, positives)
    near = _visit(blocks.withColumn("windows", F.lit(None).cast(_LISTS)), rows, known, Positives, positives, task_rows)
    down = lambda a: F.call_function("div", a - F.pmod(a, F.lit(den)), F.lit(den).cast("long"))
    chosen = cut(_ranked(near, positives, "at").select(*KEY, "at", (F.col("rank") - 1).cast("long").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (-down(-low * F.col("score"))).alias("low"), down(high * F.col("score")).alias("high")))
    for reach in known.values():
        reach.low[:], reach.high[:] = np.inf, -np.inf
    for r in chosen.filter("low <= high").groupBy("size", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        known[r["size"]].low[r.pivot], known[r["size"]].high[r.pivot] = r.low, r.high
    lists = chosen.filter("low <= high").groupBy(*KEY).agg(F.collect_list(F.struct("at", "list", "low", "high")).alias("windows"))  # a few for each anchor of a block
    far = _ranked(_visit(blocks.join(lists, KEY), rows, known, Negatives, negatives, task_rows), negatives, "at", "list")
    no_id = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c)
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(chosen, [*KEY, "at", "list"])
    return out.select("anchor_id", no_id("positive_id"), F.col("rank").cast("int").alias("rank"), no_id("negative_id"), "positive_score", "negative_score")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns: rows whose id is divisible by 100 are anchors; ids divisible by 7 have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(vectors.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding")
    return mine(rows, (F.col("id") % 100 == 0) & (F.col("id") != int(_NO_ID)))


SQL = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), anchors AS (
  SELECT row_number() OVER () AS a, vec_id, label, x FROM (SELECT DISTINCT vec_id, label, x FROM given WHERE vec_id % 100 = 0)
), scored AS (
  SELECT a, anchors.vec_id AS anchor_id, r, given.vec_id AS id, given.label = anchors.label AS same, CAST(list_inner_product(anchors.x, given.x) AS BIGINT) AS score
  FROM anchors JOIN given ON given.vec_id IS DISTINCT FROM anchors.vec_id AND len(given.x) = len(anchors.x)
), positives AS (
  SELECT a, r, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5
)
SELECT s.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.id NULLS LAST) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
