"""Nearest neighbours by inner product with a vantage-point tree for each shard.

Inner products become distances by one more coordinate: with M the largest norm, x gets
sqrt(M^2 - |x|^2) and a query 0, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  A tree's node holds a vantage point
and the nearest and farthest distance from it on either side of the median; by the triangle
inequality a side is at least ``lower`` away from a query and is passed over when ``factor * lower``
exceeds the k-th distance found so far.  Factor 1 is exact; larger ones prune more and may lose some.

Pivots are the vectors with the smallest hashes of their ids, one for ``shard_rows`` vectors, ``MOST_PIVOTS`` of
each length at most; every vector goes to its nearest pivot, and a pivot's vectors to as many shards as hold them, so each tree
is bounded.  A query is first searched in a shard of its nearest pivot, and with the k-th score found there
only in shards that the same inequality, on the shard's distances from its pivot, does not pass over.  Queries reach a shard in
packed rows that stream past its tree; a tree is copied only where its queries exceed ``task_queries``.

Scores are inner products of the given vectors in double precision, summed from the first component to the last, so
equal vectors have equal scores whatever block they are in.  Matrix products, whose last bits depend on
the block, only choose what is summed, with a margin of their largest error.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
ids; vectors are compared with those of their own length.  Rows that share an id are candidates each, but not for queries of
that id; equal queries are answered once, different ones of one id together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

LEAF = 256
MOST_PIVOTS = 4096
_ROUNDING = 1e-12  # of the sum of squared norms: above the error of a squared distance, for up to 1,000 components
_NONE = np.iinfo(np.int64).max


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, summed in the order of the components."""
    out = np.zeros(len(a))
    for at in range(0, len(a), 1 << 15):
        x, y = np.ascontiguousarray(a[at : at + (1 << 15)].T), np.ascontiguousarray(b[at : at + (1 << 15)].T)
        part = out[at : at + (1 << 15)]
        for p, q in zip(x, y):
            part += p * q
    return out


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    rest = np.sqrt(np.maximum(0.0, most * most - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def passed_over(squared: np.ndarray, error: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, factor: float) -> np.ndarray:
    """Whether no point between ``low`` and ``high`` from a vantage point can be in reach of a query at this squared distance."""
    near, far = np.sqrt(np.maximum(0.0, squared - error)), np.sqrt(np.maximum(0.0, squared) + error)
    lower = np.maximum(0.0, np.maximum(low - far, near - high))
    return factor * lower > np.sqrt(np.maximum(0.0, reach) + error)


class Tree:
    """Flat arrays: ids and vectors in the tree's order; nodes with start, stop, kind, children and bounds of both sides."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        full = lifted(vectors, most)
        order = np.lexsort((*vectors.T[::-1], ids)) if vectors.shape[1] else np.argsort(ids, kind="stable")
        nodes: list[tuple] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent][1][side] = here
            if b - a <= LEAF:
                nodes.append(((a, b, 0), [-1, -1], [0.0] * 4))
                continue
            pick = a + (b - a) // 2  # any point may serve; ids are in no order that matters
            order[a], order[pick] = order[pick], order[a]
            part = order[a + 1 : b]
            d = np.sqrt(((full[part] - full[order[a]]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[a + 1 : b], d = part[by], d[by]
            half = len(d) // 2
            nodes.append(((a, b, 1), [-1, -1], [d[0], d[half - 1], d[half], d[-1]]))
            todo += [(a + 1 + half, b, here, 1), (a + 1, a + 1 + half, here, 0)]
        self.ids, self.vectors, self.most = ids[order], vectors[order], most
        self.span = np.array([n[0] for n in nodes], np.int64).reshape(-1, 3)
        self.child = np.array([n[1] for n in nodes], np.int64).reshape(-1, 2)
        self.bounds = np.array([n[2] for n in nodes], np.float64).reshape(-1, 4)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k for each query (id -1: none), and the number of products computed.

        Only scores of at least ``least`` are looked for, where it is given.
        """
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), _NONE)
        floor = np.full(len(queries), -np.inf) if least is None else least
        norms = (queries * queries).sum(axis=1) + self.most**2
        error = _ROUNDING * norms
        work = 0

        def limit(who: np.ndarray) -> np.ndarray:
            return np.maximum(best[who, -1], floor[who])

        def meet(who: np.ndarray, a: int, b: int) -> np.ndarray:
            nonlocal work
            rough = queries[who] @ self.vectors[a:b].T
            work += rough.size
            own = self.ids[a:b][None, :] == query_ids[who, None]
            open_ = np.where(own, -np.inf, rough)
            bar = limit(who)
            if b - a > k:
                bar = np.maximum(bar, np.partition(open_, b - a - k, axis=1)[:, b - a - k] - error[who])
            row, col = np.nonzero((open_ >= (bar - error[who])[:, None]) & ~own)
            some = np.unique(row)
            if len(some):
                scores = np.full((len(some), b - a), -np.inf)
                scores[np.searchsorted(some, row), col] = inner(queries[who[row]], self.vectors[a + col])
                mine = who[some]
                scores[scores < floor[mine, None]] = -np.inf
                s = np.concatenate([best[mine], scores], axis=1)
                i = np.concatenate([found[mine], np.where(np.isinf(scores), _NONE, self.ids[a:b][None, :])], axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best[mine], found[mine] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            return rough

        todo = [(0, np.arange(len(queries)), np.full(len(queries), np.inf), 0.0, np.inf)]
        while todo:
            node, who, squared, low, high = todo.pop()
            if np.isfinite(high):
                stays = ~passed_over(squared, error[who], low, high, norms[who] - 2 * limit(who), factor)
                who = who[stays]
            if not len(who):
                continue
            a, b, inside = self.span[node]
            if not inside:
                if b > a:
                    meet(who, a, b)
                continue
            d = norms[who] - 2 * meet(who, a, a + 1)[:, 0]
            near_low, near_high, far_low, far_high = self.bounds[node]
            first = np.sqrt(np.maximum(0.0, d)) * 2 <= near_high + far_low  # nearer to the inner side
            for side, on in ((1, first), (0, ~first), (0, first), (1, ~first)):  # the last is searched first
                if on.any():
                    todo.append((self.child[node, side], who[on], d[on], *((near_low, near_high), (far_low, far_high))[side]))
        return np.where(found == _NONE, -1, found), best, work

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        np.savez(sink, ids=self.ids, vectors=self.vectors, most=self.most, span=self.span, child=self.child, bounds=self.bounds)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(data: bytes) -> Tree:
        tree = object.__new__(Tree)
        with np.load(pa.BufferReader(data)) as parts:
            for name in ("ids", "vectors", "span", "child", "bounds"):
                setattr(tree, name, parts[name])
            tree.most = float(parts["most"])
        return tree


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, dim`` of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


class Pivots:
    """Pivots of one vector length, and what the shards are like: all that tells where a query must go."""

    def __init__(self, most: float, vectors: np.ndarray):
        self.most, self.vectors, self.full = most, vectors, lifted(vectors, most)
        self.low, self.high, self.parts = np.zeros(len(vectors)), np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        full = lifted(vectors, self.most)
        return ((self.full**2).sum(axis=1)[None, :] - 2 * full @ self.full.T).argmin(axis=1)

    def first(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivot and part where each query is searched first: of the nearest pivot that has any vectors."""
        scores = np.where(self.parts[None, :] > 0, queries @ self.vectors.T, -np.inf)
        pivot = scores.argmax(axis=1)
        return pivot, ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % self.parts[pivot].astype(np.uint64)

    def visits(self, queries: np.ndarray, least: np.ndarray, factor: float) -> np.ndarray:
        """Whether each query has to be searched in each pivot's shards."""
        norms = (queries * queries).sum(axis=1) + self.most**2
        squared = norms[:, None] - 2 * queries @ self.vectors.T
        return (self.parts > 0) & ~passed_over(squared, _ROUNDING * norms[:, None], self.low, self.high, (norms - 2 * least)[:, None], factor)


def _deal(batches: Iterator[pa.RecordBatch], known: dict[int, Pivots]) -> Iterator[pa.RecordBatch]:
    """Vectors with their nearest pivot."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            pivot = np.concatenate([known[dim].nearest(_matrix(part.column(1).slice(at, 1024))) for at in range(0, part.num_rows, 1024)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int64())], names=["id", "v", "dim", "pivot"])


_INDEX = "dim int, pivot long, part long, size long, low double, high double, tree binary"


def _build(table: pa.Table, known: dict[int, Pivots]) -> pa.Table:
    dim, pivot, part = (table.column(c)[0].as_py() for c in ("dim", "pivot", "part"))
    vectors, pivots = _matrix(table.column("v")), known[dim]
    away = np.sqrt(((lifted(vectors, pivots.most) - pivots.full[pivot]) ** 2).sum(axis=1))
    tree = Tree(table.column("id").to_numpy(), vectors, pivots.most)
    return pa.table({"dim": pa.array([dim], pa.int32()), "pivot": [pivot], "part": [part], "size": [table.num_rows], "low": [float(away.min())], "high": [float(away.max())], "tree": pa.array([tree.dump()], pa.binary())})


class Index:
    """``shards`` (a table of trees) and the pivots of each vector length."""

    def __init__(self, shards: DataFrame, pivots: dict[int, Pivots]):
        self.shards, self.pivots = shards, pivots


def build_index(vectors: DataFrame, shard_rows: int = 4096) -> Index:
    """Index of the rows of ``usable``; the driver sees pivots and a row for each of them, which are bounded."""
    sizes = {r.dim: r for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most")).collect()}
    wanted = {d: min(MOST_PIVOTS, -(-r.n // shard_rows)) for d, r in sizes.items()}
    below = {d: int(-(2**63) + min(1.0, 4 * (wanted[d] + 16) / r.n) * (2**64 - 2048)) for d, r in sizes.items()}  # leaves four times as many ids as are wanted, on the mean
    of = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) if m else F.create_map().cast("map<int,bigint>"), F.col("dim"))
    some = vectors.withColumn("h", F.xxhash64("id")).filter(F.col("h") <= of(below))
    at = F.row_number().over(Window.partitionBy("dim").orderBy("h", "id", "v"))
    picked = some.withColumn("at", at).filter(F.col("at") <= MOST_PIVOTS).filter(F.col("at") <= of(wanted)).orderBy("dim", "at").select("dim", "v").toArrow()
    dims = picked.column("dim").to_numpy()
    pivots = {d: Pivots(r.most, _matrix(picked.filter(pa.array(dims == d)).column("v"))) for d, r in sizes.items()}
    dealt = cut(vectors.mapInArrow(functools.partial(_deal, known=pivots), "id long, v array<double>, dim int, pivot long"))
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    rows = dealt.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # one row for each pivot
    build = functools.partial(_build, known=pivots)
    shards = cut(rows.select("id", "v", "dim", "pivot", "part").groupBy("dim", "pivot", "part").applyInArrow(lambda t: build(t), _INDEX))
    for r in shards.groupBy("dim", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.max("part") + 1).alias("parts")).collect():
        p = pivots[r.dim]
        p.low[r.pivot], p.high[r.pivot], p.parts[r.pivot] = r.low, r.high, r.parts
    return Index(shards, pivots)


_ASKED = pa.schema([("dim", pa.int32()), ("pivot", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("least", pa.binary())])
_ASKED_SQL = "dim int, pivot long, part long, n long, ids binary, vectors binary, least binary"


def _route(batches: Iterator[pa.RecordBatch], known: dict[int, Pivots], factor: float, first: bool, block: int) -> Iterator[pa.RecordBatch]:
    """Packed queries for the shards that they have to visit: the first one, or all others."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            pivots = known.get(int(dim))
            if pivots is None:
                continue
            for at in range(0, rows.num_rows, block):
                some = rows.slice(at, block)
                ids, vectors = some.column(0).to_numpy(), _matrix(some.column(1))
                home, part = pivots.first(ids, vectors)
                least = np.full(len(ids), -np.inf) if first else some.column(3).to_numpy(zero_copy_only=False)
                if first:
                    goes = [(p, q, np.flatnonzero((home == p) & (part == q))) for p, q in sorted(set(zip(home.tolist(), part.tolist())))]
                else:
                    visits = pivots.visits(vectors, least, factor)
                    goes = ((p, q, np.flatnonzero(visits[:, p] & ~((home == p) & (part == q)))) for p in np.flatnonzero(visits.any(axis=0)).tolist() for q in range(int(pivots.parts[p])))
                out = [(int(dim), p, q, len(w), ids[w].tobytes(), vectors[w].tobytes(), least[w].tobytes()) for p, q, w in goes if len(w)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASKED)], schema=_ASKED)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """A shard's tree comes first, then the packed queries that visit it."""
    tree = at = None
    for batch in batches:
        trees, dims, ids, vectors, least = (batch.column(c) for c in ("tree", "dim", "ids", "vectors", "least"))
        shards = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "pivot", "part", "copy"))))
        for i in range(batch.num_rows):
            if trees[i].is_valid:
                tree, at = Tree.load(trees[i].as_py()), shards[i]
                continue
            if at != shards[i]:  # no vector was dealt to this part
                continue
            query_ids = np.frombuffer(ids[i].as_py(), np.int64)
            q = np.frombuffer(vectors[i].as_py(), np.float64).reshape(len(query_ids), dims[i].as_py())
            found, scores, _ = tree.search(query_ids, q, k, factor, np.frombuffer(least[i].as_py(), np.float64))
            row, col = np.nonzero(found >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found[row, col]), pa.array(scores[row, col])], schema=_FOUND)


def _visit(index: Index, asked: DataFrame, k: int, factor: float, task_queries: int) -> DataFrame:
    """Neighbours found in the shards that packed queries visit."""
    key = ["dim", "pivot", "part"]
    asked = cut(asked)
    loads = asked.groupBy(*key).agg(F.ceil(F.sum("n") / task_queries).cast("long").alias("copies"))
    none = F.lit(None).cast("binary")
    trees = index.shards.join(loads, key).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("turn"), "tree", none.alias("ids"), none.alias("vectors"), none.alias("least"))
    queries = asked.join(loads, key).select(*key, F.pmod(F.xxhash64("ids"), "copies").alias("copy"), F.lit(1).alias("turn"), none.alias("tree"), "ids", "vectors", "least")
    rows = trees.unionByName(queries).repartition(*key, "copy").sortWithinPartitions(*key, "copy", "turn")
    return rows.mapInArrow(functools.partial(_search, k=k, factor=factor), "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 20, factor: float = 1.1, block_rows: int = 512, task_queries: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best k of ``index`` for each row of ``queries`` (as of ``usable``)."""
    queries = queries.dropDuplicates(["id", "v"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    route = functools.partial(_route, known=index.pivots, factor=factor, block=block_rows)
    near = cut(_visit(index, queries.mapInArrow(functools.partial(route, first=True), _ASKED_SQL), k, factor, task_queries))
    least = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = queries.join(least, "id", "left").select("id", "v", "dim", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    far = _visit(index, bounded.mapInArrow(functools.partial(route, first=False), _ASKED_SQL), k, factor, task_queries)
    found = near.unionByName(far)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns: rows whose id is divisible by 20, against all rows."""
    rows = usable(vectors, "vec_id", "embedding")
    return search(build_index(rows), rows.filter(F.col("id") % 20 == 0))
