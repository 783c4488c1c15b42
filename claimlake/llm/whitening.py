"""Whitening of embeddings by a covariance that is recovered from variances alone.

Components become integers, ``x = floor(scale * c)``, and the fit list holds each distinct x once: n vectors with sums S of
each dimension.  With y = n x - S, which is exact and centred, tasks add up y_i^2 for each dimension and (y_i + y_j)^2
for each pair of dimensions.  By polarisation (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, so differences of these sums are the
cross-covariances, times n^3; nothing is rounded before the matrix goes to ``eigh``.

Squares are summed as integers in three parts (t = 2^24 hi + lo: hi^2, hi lo, lo^2), each a decimal that holds over 10^11 vectors.
The driver sees one row for each dimension and one for each pair; both depend on the vectors' length alone.

Vectors that are null or hold null or non-finite entries take no part.  Vectors of another length are another fit, with its own n; an
empty vector has no component.  Rows that repeat, or share an id, are rows each and one vector of the fit list; rows with null ids are
whitened like others.  Components without variance (all, where n is 1) cannot be whitened and are left out.  A tie
of eigenvalues leaves the choice of axes to ``eigh``; an axis points where its entry of largest magnitude, the first of such, is positive.
Components of 2^62 / ``scale`` and more are an error, as is a deviation beyond 64 bits.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE = 256
_SAFE = 2**62
_SHIFT = 24


def quantised(vectors: DataFrame, vector_col: str, *keep: str, scale: int = SCALE) -> DataFrame:
    """``keep`` and ``x`` (integers) of the rows whose vectors take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = lambda c: F.when(F.abs(c) < _SAFE / scale, F.floor(c * float(scale))).otherwise(F.raise_error(F.lit("a component is too large to be an integer")).cast("long"))
    return vectors.filter(fine).select(*keep, F.transform(v, whole).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer matrix of each vector length in a batch of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        some = column if len(rows) == len(column) else column.take(pa.array(rows))
        yield rows, some.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def totals(a: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    return a.astype(object).sum(axis=0) if largest(a) * len(a) >= _SAFE else a.sum(axis=0).astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they hold it, Python's elsewhere."""
    if n * largest(x) + max(map(abs, sums), default=0) < _SAFE // 4:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squares(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of hi^2, hi lo and lo^2 of each column, exact."""
    most = largest(t)
    if most * most * len(t) < _SAFE:
        return 0, 0, np.einsum("ij,ij->j", t, t).astype(object)
    if most >= 2**46 or len(t) > 2**14:
        t = t.astype(object)
    hi, lo = t >> _SHIFT, t & (2**_SHIFT - 1)
    return tuple((a * b).sum(axis=0).astype(object) for a, b in ((hi, hi), (hi, lo), (lo, lo)))


def _decimals(values) -> pa.Array:  # noqa: ANN001
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of the vectors of a task: a row for each length and dimension."""
    known: dict[int, list] = {}
    for batch in batches:
        for rows, x in matrices(batch.column(0)):
            had = known.setdefault(x.shape[1], [0, 0])
            had[0] += len(rows)
            had[1] = had[1] + totals(x)
    for size, (n, sums) in known.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array([n] * size, pa.int64()), _decimals(sums)], names=["size", "i", "n", "total"])


def _polarise(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Squares of a task's centred values: a row for each dimension (i = j) and for the sum of each pair (i < j)."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            fit, size = fits[x.shape[1]], x.shape[1]
            y = centred(x, fit.n, fit.sums)
            had = known.setdefault(size, np.zeros((3, size, size), object))
            for i in range(size):
                t = y[:, i:] + y[:, i : i + 1]
                t[:, 0] = y[:, i]
                for part, add in zip(had, squares(t)):
                    part[i, i:] += add
    for size, parts in known.items():
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(_decimals(p[i, j]) for p in parts)], names=["size", "i", "j", "hh", "hl", "ll"])


@dataclass
class Fit:
    """What is known of the vectors of one length; ``axes`` has a column for each component."""

    n: int
    sums: np.ndarray
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def solve(self, cross: list[list[int]], components: int) -> None:
        """Axes from the exact cross products of y."""
        size, cube = len(self.sums), self.n**3
        v = np.array([[c / cube for c in row] for row in cross]).reshape(size, size)  # of Python integers: rounded once
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        held = int((values > size * np.finfo(float).eps * max(values[0], 0.0)).sum())
        k = min(components, held)
        at = np.abs(axes[:, :k]).argmax(axis=0)
        self.axes, self.values = axes[:, :k] * np.sign(axes[at, np.arange(k)]), values[:k]
        trace = sum(cross[i][i] for i in range(size))
        self.explained = self.values / (trace / cube) if k else np.zeros(0)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of centred vectors, added in the order of dimensions, so that equal vectors have equal values."""
        out = np.zeros((len(y), len(self.values)))
        for c, axis in zip((y / self.n).astype(np.float64).T, self.axes):
            out += c[:, None] * axis
        return out / np.sqrt(self.values)


def deviations(y: np.ndarray) -> np.ndarray:
    """Sums of squares of the rows, exact."""
    if largest(y) ** 2 * max(1, y.shape[1]) < _SAFE:
        return np.einsum("ij,ij->i", y, y)
    out = (y.astype(object) ** 2).sum(axis=1)
    if len(out) and max(out) >= 2**63:
        raise OverflowError("a deviation does not fit 64 bits")
    return out.astype(np.int64)


def _products(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Sums of products of a task's whitened values, whose mean is zero as y is centred."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            fit = fits[x.shape[1]]
            w = fit.whiten(centred(x, fit.n, fit.sums))
            known[x.shape[1]] = known.get(x.shape[1], 0.0) + w.T @ w
    for size, m in known.items():
        i, j = np.indices(m.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], names=["size", "i", "j", "product"])


def fit(x: DataFrame, components: int = 4) -> dict[int, Fit]:
    """Fits by vector length, over the distinct vectors of column ``x``."""
    listed = cut(x.select("x").filter(F.size("x") > 0).distinct())
    rows = listed.mapInArrow(_sum, "size int, i int, n long, total decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("size", "i").collect()
    fits: dict[int, Fit] = {}
    for size in sorted({r["size"] for r in rows}):
        own = [r for r in rows if r["size"] == size]
        fits[size] = Fit(own[0].n, np.array([int(r.total) for r in own], object))
    sums = listed.mapInArrow(functools.partial(_polarise, fits=fits), "size int, i int, j int, hh decimal(38,0), hl decimal(38,0), ll decimal(38,0)")
    pairs = sums.groupBy("size", "i", "j").agg(*(F.sum(c).alias(c) for c in ("hh", "hl", "ll"))).toArrow().to_pylist()
    squared = {size: [[0] * size for _ in range(size)] for size in fits}
    for r in pairs:
        squared[r["size"]][r["i"]][r["j"]] = (int(r["hh"]) << 2 * _SHIFT) + (int(r["hl"]) << _SHIFT + 1) + int(r["ll"])
    for size, q in squared.items():
        cross = [[q[i][i] if i == j else (q[min(i, j)][max(i, j)] - q[i][i] - q[j][j]) // 2 for j in range(size)] for i in range(size)]
        fits[size].solve(cross, components)
    products = listed.mapInArrow(functools.partial(_products, fits=fits), "size int, i int, j int, product double").groupBy("size", "i", "j").agg(F.sum("product").alias("product"))
    for r in products.collect():
        f = fits[r["size"]]
        f.identity_error = max(f.identity_error, abs(r["product"] / f.n - (r["i"] == r["j"])))
    return fits


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _apply(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in matrices(batch.column(1)):
            if not x.shape[1]:
                continue
            f = fits[x.shape[1]]
            y = centred(x, f.n, f.sums)
            w = f.whiten(y)
            k = w.shape[1]
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            tile = lambda a: pa.array(np.tile(a, len(rows)))
            yield pa.RecordBatch.from_arrays(
                [ids, tile(np.arange(1, k + 1, dtype=np.int32)), tile(np.full(k, f.n)), pa.array(np.repeat(deviations(y), k)), pa.array(w.ravel()), tile(f.explained), tile(np.full(k, f.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = 4, scale: int = SCALE) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and component."""
    x = quantised(vectors, vector_col, F.col(id_col).alias("id"), scale=scale)
    return x.select("id", "x").mapInArrow(functools.partial(_apply, fits=fit(x, components)), f"id {x.schema['id'].dataType.simpleString()}, {_OUT}")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns."""
    return whiten(vectors, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
