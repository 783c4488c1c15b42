"""Vectorised words and word hashes of whole texts, used inside Arrow tasks.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All separators
are ASCII, so cutting the UTF-8 bytes gives the same words as cutting the string.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TERM_GAP = np.ones(256, bool)  # all but letters, digits and bytes of other scripts
_TERM_GAP[[*b"0123456789", *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = False
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9FB21C651E98DF25) + b)


@functools.lru_cache(2)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@dataclass
class Words:
    """Words of consecutive texts. ``ends`` is exclusive; ``first[i]`` is text i's first word."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    prefixes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: list[bytes], fold: bool = False, slice_bytes: int = 1 << 20, terms: bool = False, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of each text with 64-bit hashes; ``fold`` lower-cases A-Z for the hash.

    ``terms`` takes runs of letters and digits instead; ``prefixes`` adds hashes of each
    word's first bytes, as many as given.
    """
    raw = b" ".join(texts) + b" "
    buffer = np.frombuffer(raw, np.uint8)
    inside = ~(_TERM_GAP if terms else _SPACE)[buffer]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    first = np.searchsorted(starts, text_start)
    hashes = np.empty(len(starts), U64)
    heads = np.empty((len(prefixes), len(starts)), U64)
    values = _byte_values(fold)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + slice_bytes, "right")))
        last = ends[to - 1]
        size = int(last - origin)
        power, inverse = _powers(max(slice_bytes, 1 << (size - 1).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.empty(size + 1, U64)
            sums[0] = 0
            np.cumsum(values[buffer[origin:last]] * power[:size], out=sums[1:])
            s, e = starts[at:to] - origin, ends[at:to] - origin
            hashes[at:to] = mix((sums[e] - sums[s]) * inverse[s])
            for k, size_ in enumerate(prefixes):
                heads[k, at:to] = mix((sums[np.minimum(e, s + size_)] - sums[s]) * inverse[s] + U64(size_))
        at = to
    return Words(buffer, starts, ends, hashes, first, heads)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes, by doubling; one value for each start that has n."""
    if n <= 0 or len(h) < n:
        return np.zeros(0, U64)
    out, done, block, width = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            piece = block[done:]
            out = piece if out is None else pair_hash(out[: len(piece)], piece)
            done += width
        left >>= 1
        if left:
            block = pair_hash(block[: len(block) - width], block[width:])
            width *= 2
    return out[: len(h) - n + 1]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the text of each; a shorter text is one shingle."""
    counts = words.counts
    runs = run_hashes(words.hashes, n)
    doc = words.doc()
    inside = doc[: len(runs)] == doc[n - 1 :] if len(runs) else np.zeros(0, bool)
    hashes, owner = runs[inside], doc[: len(runs)][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.empty(len(short), U64)
        for i, d in enumerate(short):
            h = words.hashes[words.first[d] : words.first[d + 1]]
            whole[i] = run_hashes(h, len(h))[0] ^ U64(len(h))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def shingle_sets(texts: list[bytes], n: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, concatenated, and their offsets."""
    hashes, owner = shingles(words_of(texts, fold), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def text_blocks(texts: list, most_bytes: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a list of strings (null: empty) into runs of about ``most_bytes``, with their start."""
    block, start, size = [], 0, 0
    for i, t in enumerate(texts):
        raw = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > most_bytes:
            yield start, block
            block, start, size = [], i, 0
        block.append(raw)
        size += len(raw)
    if block:
        yield start, block
