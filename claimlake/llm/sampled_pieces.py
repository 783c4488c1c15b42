"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

The lattice of a text has an edge for each piece of the vocabulary that matches there, and byte pieces
where a character is no piece itself.  A piece of rank r by score weighs ``(r + 1) ** -alpha``
(Zipf's law for the ranks, which is all that a BPE model tells; larger ``alpha`` prefers fewer, more frequent
pieces).  Forward sums give the weight of all segmentations up to each byte; walking back, each
last piece is drawn in proportion, so a segmentation is drawn with its share of the weight.

Draws come from the row key, the place of the chunk in the text and the byte, so they do not depend on
partitions.  No piece spans a space after another character, so the lattice falls apart into chunks
(spaces, then other characters); each distinct chunk of a block is filtered once, all chunks of
a length together, and every occurrence is drawn for itself.  A chunk of over ``LONG`` bytes is filtered by itself in
windows, of which only the sums are kept (8 bytes for each byte); walking back, the edges are found once more.

A space is put before each text, as SentencePiece does, and taken away on decoding.  A literal U+2581
goes into bytes, so decoding gives back every text.  Null and empty texts have no pieces.  Rows of one id with equal texts are
drawn alike, and a null id draws as id 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix, text_blocks

LONG = 64  # bytes of a chunk beyond which it is filtered alone
WINDOW = 4096  # bytes of a long chunk whose edges are held at a time
_SCALE = 100.0  # weight for each byte, the same for all paths, against underflow
_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=U64)) | U64(1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums along the last axis, with a leading 0."""
    power, _ = _powers(1 << max(6, (data.shape[-1] - 1).bit_length()))
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), U64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * power[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


class Lattice:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ordinary = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {i: sp.id_to_piece(i).replace("▁", " ").encode() for i in ordinary}
        if any(b" " in r.lstrip(b" ") for r in raw.values()):
            raise ValueError("a piece spans a space")
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
                raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        rank = np.empty(len(ordinary))
        rank[np.argsort([-sp.get_score(i) for i in ordinary], kind="stable")] = np.arange(len(ordinary))
        weight = dict(zip(ordinary, (rank + 1) ** -alpha))
        self.byte_weight = _SCALE * float(n) ** -alpha
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seen = np.zeros(1 << 22, bool)
        for length in sorted({len(raw[i]) for i in ordinary}):
            ids = np.array([i for i in ordinary if len(raw[i]) == length])
            keys = _prefix_sums(np.frombuffer(b"".join(raw[i] for i in ids), np.uint8).reshape(-1, length))[:, length]
            order = np.argsort(keys)
            self.by_length[length] = keys[order], ids[order], np.array([weight[i] for i in ids[order]]) * _SCALE**length
            self.seen[(mix(keys) & U64(len(self.seen) - 1)).astype(np.int64)] = True
        self.longest = max(self.by_length)
        self.n_bytes = np.array([len(raw.get(i, b"")) for i in range(n)])
        self.begin = np.concatenate([[0], np.cumsum(self.n_bytes)])[:-1]
        self.pool = np.frombuffer(b"".join(raw.get(i, b"") for i in range(n)), np.uint8)

    def _matches(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``length, row, start, weight, piece`` of the edges of rows of bytes, by length; those of single bytes last."""
        m, n = data.shape
        sums = _prefix_sums(data)
        _, inverse = _powers(1 << max(6, (n - 1).bit_length()))
        lead = np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)
        bare = lead > 0  # characters that are no piece so far
        for length, (keys, ids, weights) in self.by_length.items():
            if length > n:
                break
            with np.errstate(over="ignore"):
                h = (sums[:, length:] - sums[:, : n - length + 1]) * inverse[: n - length + 1]
            row, at = np.nonzero(self.seen[(mix(h) & U64(len(self.seen) - 1)).astype(np.int64)])
            h = h[row, at]
            k = np.searchsorted(keys, h).clip(max=len(keys) - 1)
            ok = keys[k] == h
            row, at, k = row[ok], at[ok], k[ok]
            whole = lead[row, at] == length
            bare[row[whole], at[whole]] = False
            yield length, row, at, weights[k], ids[k]
        row, at = np.nonzero(bare)
        size = lead[row, at]
        for k in range(4):
            r, x = row[size > k], at[size > k] + k
            r, x = r[x < n], x[x < n]
            yield 1, r, x, np.full(len(r), self.byte_weight), self.byte_ids[data[r, x]]

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and piece of each (row, start, length - 1) of rows of bytes; weight 0 where there is none."""
        m, n = data.shape
        top = min(n, self.longest)
        weight, piece = np.zeros((m, n, top)), np.zeros((m, n, top), np.int32)
        for length, row, at, w, ids in self._matches(data):
            weight[row, at, length - 1], piece[row, at, length - 1] = w, ids
        return weight, piece

    def _ending(self, data: np.ndarray, a: int, b: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """Edges that end in (a, b], by end and length: where each end's begin in the lists, their starts, weights and pieces."""
        low = max(0, a - self.longest - 4)
        while low and 0x80 <= data[low] < 0xC0:
            low -= 1
        found = [(at + length, np.full(len(at), length), w, ids) for length, _, at, w, ids in self._matches(data[None, low:b])]
        end, length, weight, piece = (np.concatenate(c) for c in zip(*found))
        end = end + low
        order = np.lexsort((length, end))
        order = order[end[order] > a]
        end = end[order]
        first = np.searchsorted(end, np.arange(a + 1, b + 2))
        return first.tolist(), (end - length[order]).tolist(), weight[order].tolist(), piece[order].tolist()

    def _windows(self, data: np.ndarray) -> list[tuple[int, int]]:
        """Runs of about ``WINDOW`` bytes that end with a character."""
        cuts = [0]
        while cuts[-1] < len(data):
            b = min(len(data), cuts[-1] + WINDOW)
            while b < len(data) and 0x80 <= data[b] < 0xC0:
                b += 1
            cuts.append(b)
        return list(zip(cuts[:-1], cuts[1:]))

    def _long(self, data: np.ndarray, seed: int) -> np.ndarray:
        """Pieces drawn for one long chunk."""
        logs = np.full(len(data) + 1, -np.inf)
        logs[0] = 0.0
        for a, b in self._windows(data):
            first, starts, weights, _ = self._ending(data, a, b)
            low = max(0, a - self.longest)
            base = logs[low : a + 1].max()
            total = np.exp(logs[low : a + 1] - base).tolist()
            for end in range(a + 1, b + 1):
                x, y = first[end - a - 1], first[end - a]
                t = sum(total[s - low] * w for s, w in zip(starts[x:y], weights[x:y]))
                total.append(t)
                if t and not 1e-60 < t < 1e60:
                    logs[end] = np.log(t) + base
                    recent = logs[max(low, end - self.longest) : end + 1]
                    base = recent.max()
                    total[-len(recent) :] = np.exp(recent - base).tolist()
                elif t:
                    logs[end] = np.log(t) + base
        out, at = [], len(data)
        for a, b in reversed(self._windows(data)):
            if at <= a:
                continue
            first, starts, weights, pieces = self._ending(data, a, b)
            while at > a:
                x, y = first[at - a - 1], first[at - a]
                share = logs[starts[x:y]] - logs[at]
                share = np.cumsum(np.exp(share) * weights[x:y])
                with np.errstate(over="ignore"):
                    u = float(mix(np.array([seed + U64(at)], U64))[0] >> U64(11)) * 2.0**-53
                k = x + min(int(np.searchsorted(share, u * share[-1], "right")), y - x - 1)
                out.append(pieces[k])
                at = starts[k]
        return np.array(out[::-1], np.int64)

    def _shares(self, weight: np.ndarray) -> np.ndarray:
        """For each (row, end - 1): running shares of the last piece's lengths."""
        m, n, top = weight.shape
        total = np.zeros((m, n + 1))
        total[:, 0] = 1
        out = np.ones((m, n, top), np.float32)
        for end in range(1, n + 1):
            reach = min(end, top)
            span = np.arange(1, reach + 1)
            parts = np.cumsum(total[:, end - span] * weight[:, end - span, span - 1], axis=1)
            total[:, end] = parts[:, -1]
            with np.errstate(invalid="ignore", divide="ignore"):
                out[:, end - 1, :reach] = parts / parts[:, -1:]
        return out

    def _draw(self, shares: np.ndarray, piece: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Piece + 1 at each (occurrence, start), 0 where none starts. ``row``: each occurrence's chunk."""
        _, n, top = piece.shape
        out = np.zeros((len(row), n), np.int32)
        at = np.full(len(row), n)
        for end in range(n, 0, -1):
            who = np.flatnonzero(at == end)
            if not len(who):
                continue
            with np.errstate(over="ignore"):
                u = (mix(key[who] + U64(end)) >> U64(11)).astype(np.float64) * 2.0**-53
            reach = min(end, top)
            length = 1 + (shares[row[who], end - 1, : reach - 1] <= u[:, None]).sum(axis=1)
            start = end - length
            out[who, start] = piece[row[who], start, length - 1] + 1
            at[who] = start
        return out

    def sample(self, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and how many each has."""
        marked = [b" " + t if t else t for t in texts]
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        data = np.frombuffer(b"".join(marked), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        space = data == 0x20
        cut = space & ~np.concatenate([[False], space[:-1]])
        first = np.concatenate([[0], ends[:-1]])
        cut[first[first < len(data)]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        owner = np.searchsorted(ends, starts, "right")
        place = np.arange(len(starts)) - np.searchsorted(owner, owner)
        with np.errstate(over="ignore"):
            seed = mix(mix(keys)[owner] + place.astype(U64) * U64(_BASE))
        counts, found = np.zeros(len(starts), np.int64), []
        order = np.argsort(sizes, kind="stable")
        edge = np.flatnonzero(np.diff(sizes[order])) + 1
        for who in np.split(order, edge):
            n = int(sizes[who[0]])
            if n > LONG:
                for i in who:
                    ids = self._long(data[starts[i] : starts[i] + n], seed[i])
                    counts[i] = len(ids)
                    found.append((np.array([i]), ids))
                continue
            for part in np.array_split(who, -(-len(who) // 50_000)):
                rows = data[starts[part, None] + np.arange(n)]
                _, one, row = np.unique(_prefix_sums(rows)[:, n], return_index=True, return_inverse=True)
                weight, piece = self._edges(rows[one])
                ids = self._draw(self._shares(weight), piece, row, seed[part])
                counts[part] = (ids > 0).sum(axis=1)
                found.append((part, ids[ids > 0] - 1))
        before = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for part, ids in found:
            n = counts[part]
            out[np.repeat(before[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of runs of ids."""
        size = self.n_bytes[ids]
        data = self.pool[np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
        stops = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(stops[:-1], stops[1:])]


@functools.lru_cache(2)
def lattice_of(path: str, alpha: float) -> Lattice:
    """One for each Python worker."""
    return Lattice(path, alpha)


def _encode(batches: Iterator[pa.RecordBatch], path: str, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(path, alpha)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, block in text_blocks(texts, 1 << 20):
            own = ids.slice(start, len(block))
            keys = np.array([i or 0 for i in own.to_pylist()], np.int64).view(U64) ^ U64(seed)
            pieces, counts = lattice.sample(block, mix(keys))
            same = [a == b for a, b in zip(lattice.decode(pieces, counts), block)]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([own, pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pieces.astype(np.int32))), pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """``doc_id, n_pieces, ids, lossless`` of each row; ``lossless`` compares the decoded ids with the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(functools.partial(_encode, path=model or default_model(), alpha=alpha, seed=seed), "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def _decode(batches: Iterator[pa.RecordBatch], path: str, alpha: float) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(path, alpha)
    for batch in batches:
        lists = batch.column(1).to_pylist()
        counts = np.array([len(x or []) for x in lists], np.int64)
        texts = lattice.decode(np.array([i for x in lists for i in x or []], np.int64), counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null lists are empty texts."""
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decode, path=model or default_model(), alpha=1.0), "doc_id long, text string")
