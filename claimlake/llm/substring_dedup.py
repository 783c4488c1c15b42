"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

The corpus is a string of words.  Its suffixes are split by variable-length
prefixes (1, 2, 4, ... words, as deep as a count of all suffixes demands) into
groups that fit in a task's memory.  Each group's sorted suffixes with the depths
shared by neighbours are its subtree (``Subtree``); a node at depth ``min_words`` or deeper with
suffixes of two documents is a repeat, which stays in the document with the
smallest id and is removed from the others.  Suffixes are cut at that depth, as deeper nodes change nothing.
Neighbouring windows merge to maximal repeats.

A suffix carries blocks of word hashes (words 1, 2, 3-4, 5-8, ...; 128 bits in all for 13
words, 64 bits for each block where there are fewer than five), so texts cross the network once: the exchange by ``part`` is
reused by all steps.  Only suffixes beside a word n-gram that two documents share
can lie under a deep node; winnowing (Schleimer, Wilkerson & Aiken 2003) finds
these n-grams first, without loss: every window holds at least one selected n-gram.

What many rows share is settled where it is first seen: a part has a subtree of its own suffixes, and of each of its deep
nodes only one suffix of the smallest document goes on to the group's tree, the others are marked at
once.  So one passage in a third of all rows adds one suffix per part, about 30 bytes for each ``part_words`` words.

Nulls: a null text has no words; a row whose id is null keeps all its words and
takes none from others.  Rows with the same id never remove each other's words.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix, run_hashes, text_blocks, words_of

LEVELS = (1, 2, 4, 8)
CELLS = 1 << 14
_NONE = np.iinfo(np.int64).max


def _sorted_rows(table: pa.Table) -> tuple[list, list]:
    """Rows of a part in an order that does not depend on how they arrived."""
    ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
    return [ids[i] for i in order], [texts[i] for i in order]


class _Part:
    """Word hashes of one part: ``row`` of each word, ``doc`` id of each row."""

    def __init__(self, table: pa.Table):
        self.ids, self.texts = _sorted_rows(table)
        self.doc = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, block in text_blocks(self.texts):
            w = words_of(block)
            hashes.append(w.hashes)
            counts.append(w.counts)
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.counts)

    def starts(self, n: int) -> np.ndarray:
        """Whether n words of one row, with an id, start at each of the first words."""
        m = max(0, len(self.hashes) - n + 1)
        return (self.row[:m] == self.row[n - 1 : n - 1 + m]) & (self.doc[self.row[:m]] != _NONE)


def _anchors(part: _Part, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: positions of n-grams such that every window holds one, and their hashes."""
    grams = run_hashes(part.hashes, gram)
    width = min_words - gram + 1
    windows = part.starts(min_words)
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    best = np.arange(len(windows))
    for k in range(1, width):
        other = np.arange(k, k + len(windows))
        best = np.where(grams[other] < grams[best], other, best)
    at = np.unique(best[windows])
    return at, grams[at]


def _repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its key has several documents, and the key's smallest document."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(k)]]) - 1 if len(k) else head
    many, least = np.empty(len(k), bool), np.empty(len(k), np.int64)
    many[order] = (d[head] != d[tail])[group] if len(k) else many
    least[order] = d[head][group] if len(k) else least
    return many, least


_BLOB = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])


def _pack(to: np.ndarray, part: int, records: np.ndarray) -> pa.Table:
    """One row for each target, holding its records as bytes."""
    order = np.argsort(to, kind="stable")
    to, records = to[order], records[order]
    head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
    ends = [*head[1:], len(to)]
    return pa.table([pa.array(to[head], pa.int64()), pa.array([part] * len(head), pa.int64()), pa.array([records[a:b].tobytes() for a, b in zip(head, ends)], pa.binary())], schema=_BLOB)


_GRAM = np.dtype([("hash", "<u4"), ("at", "<u4")])


def _anchor_step(table: pa.Table, min_words: int, gram: int, buckets: int) -> pa.Table:
    part = _Part(table)
    at, hashes = _anchors(part, min_words, gram)
    docs = part.doc[part.row[at]]
    _, least = _repeats(hashes, docs)
    own = _first_in_key(hashes, docs == least)  # the others repeat inside this part, as later steps see again
    records = np.empty(int(own.sum()), _GRAM)
    records["hash"], records["at"] = (hashes[own] >> U64(32)).astype(np.uint32), at[own]
    return _pack((hashes[own] % U64(buckets)).astype(np.int64), table.column("part")[0].as_py() if table.num_rows else 0, records)


def _unpack(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a group's blobs, and the part of each."""
    blobs = [np.frombuffer(b, dtype) for b in table.column("data").to_pylist()]
    parts = np.array(table.column("part").to_pylist(), np.int64)
    return (np.concatenate(blobs) if blobs else np.empty(0, dtype)), np.repeat(parts, [len(b) for b in blobs])


def _shared_step(table: pa.Table) -> pa.Table:
    """Selected n-grams of several parts, sent back to them; 32 bits do, as the trees decide."""
    records, parts = _unpack(table, _GRAM)
    _, which, n = np.unique(records["hash"], return_inverse=True, return_counts=True)
    many = n[which] > 1
    return _pack(parts[many], 0, records["at"][many].copy())


def _block_widths(min_words: int) -> list[int]:
    out, done = [], 0
    while done < min_words:
        out.append(min(max(1, done), min_words - done))
        done += out[-1]
    return out


def _cell(level: int, h: np.ndarray) -> np.ndarray:
    return level * CELLS + (h & U64(CELLS - 1)).astype(np.int64)


def _prefix_cells(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """The cell of each suffix's prefix of 1, 2, 4 and 8 words."""
    out = []
    for level, words in enumerate(w for w in LEVELS if w <= n):
        runs = run_hashes(hashes, words)
        out.append(_cell(level, mix(runs)))
    return out


def prefix_groups(counts: dict[int, int], most: int) -> np.ndarray:
    """Group of each prefix cell, -1 where the prefix must be longer.

    Neighbouring cells share a group until it holds ``most`` suffixes; a cell that alone holds
    more is split by longer prefixes, except at the last level.
    """
    size = np.zeros(CELLS * len(LEVELS), np.int64)
    size[list(counts)] = list(counts.values())
    last = len(LEVELS) - 1
    heavy = (size > most) & (np.arange(len(size)) < last * CELLS)
    return np.where(heavy, -1, np.cumsum(np.where(heavy, 0, size)) // most)


def _group_of(hashes: np.ndarray, at: np.ndarray, n: int, groups: np.ndarray) -> np.ndarray:
    """Group of each suffix, by the shortest prefix that has one."""
    out = np.full(len(at), -1, np.int64)
    for cell in _prefix_cells(hashes, n):
        out = np.where(out < 0, groups[cell[at]], out)
    return out


def _block_bits(min_words: int) -> list[int]:
    """With five blocks or more, those of one word take 16 bits, as the group tells more of them, and longer ones 32."""
    widths = _block_widths(min_words)
    return [64] * len(widths) if len(widths) < 5 else [16 if w == 1 else 32 for w in widths]


def _suffix_dtype(min_words: int) -> np.dtype:
    return np.dtype([*((f"k{i}", f"<u{bits // 8}") for i, bits in enumerate(_block_bits(min_words))), ("doc", "<i8"), ("at", "<u4")])


def _blocks(records: np.ndarray) -> list[np.ndarray]:
    return [records[name] for name in records.dtype.names[:-2]]


def _suffixes(part: _Part, at: np.ndarray, min_words: int) -> np.ndarray:
    records = np.empty(len(at), _suffix_dtype(min_words))
    done = 0
    for k, (width, bits) in enumerate(zip(_block_widths(min_words), _block_bits(min_words))):
        runs = run_hashes(part.hashes, width)
        records[f"k{k}"] = mix(runs[at + done]) >> U64(64 - bits)
        done += width
    records["doc"], records["at"] = part.doc[part.row[at]], at
    return records


class Subtree:
    """The sorted suffixes of a group or part; ``depth`` words are shared by each and the next, as far as blocks tell."""

    def __init__(self, records: np.ndarray, min_words: int):
        blocks = _blocks(records)
        self.order = np.lexsort(blocks[::-1])
        self.depth = np.zeros(max(0, len(records) - 1), np.int64)
        open_ = np.ones(len(self.depth), bool)
        for block, width in zip(blocks, _block_widths(min_words)):
            block = block[self.order]
            open_ &= block[1:] == block[:-1]
            self.depth += width * open_

    def nodes(self, depth: int) -> np.ndarray:
        """The number of the node at ``depth`` words, or the leaf, over each suffix: a run of neighbours that share so many."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.depth < depth)
        return out


def _hot_windows(part: _Part, marks: pa.Table, min_words: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a shared n-gram."""
    at, hashes = _anchors(part, min_words, gram)
    shared, _ = _repeats(hashes, part.doc[part.row[at]])
    remote = [np.frombuffer(b, "<u4") for b in marks.column("data").to_pylist()]
    hot = np.concatenate([at[shared], *[r.astype(np.int64) for r in remote]])
    if len(remote):  # other copies of these n-grams in this part
        known = np.isin(hashes, hashes[np.searchsorted(at, np.unique(np.concatenate(remote)))])
        hot = np.concatenate([hot, at[known]])
    windows = part.starts(min_words)
    step = np.zeros(len(part.hashes) + 2, np.int32)
    hot = np.unique(hot)
    np.add.at(step, np.maximum(0, hot - (min_words - gram)), 1)
    np.add.at(step, hot + 1, -1)
    return np.flatnonzero((np.cumsum(step)[: len(windows)] > 0) & windows)


def _local(part: _Part, marks: pa.Table, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot suffixes, whether each waits for the group's tree, and its deep node in the part's own tree."""
    at = _hot_windows(part, marks, min_words, gram)
    records = _suffixes(part, at, min_words)
    nodes = Subtree(records, min_words).nodes(min_words)
    _, least = _repeats(nodes, records["doc"])
    return records, records["doc"] == least, nodes


def _suffix_step(table: pa.Table, marks: pa.Table, min_words: int, gram: int, groups: np.ndarray) -> pa.Table:
    if not table.num_rows:
        return _BLOB.empty_table()
    part = _Part(table)
    records, waits, nodes = _local(part, marks, min_words, gram)
    records = records[_first_in_key(nodes, waits)]  # one for each deep node of this part
    group = _group_of(part.hashes, records["at"].astype(np.int64), min_words, groups)
    return _pack(group, table.column("part")[0].as_py(), records)


def _first_in_key(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    where = np.flatnonzero(among)
    out[where[np.unique(keys[where], return_index=True)[1]]] = True
    return out


def _tree_step(table: pa.Table, min_words: int) -> pa.Table:
    """Suffixes under a deep node with a smaller document, sent back to their parts."""
    records, parts = _unpack(table, _suffix_dtype(min_words))
    _, least = _repeats(Subtree(records, min_words).nodes(min_words), records["doc"])
    repeat = records["doc"] > least
    return _pack(parts[repeat], 0, records["at"][repeat].copy())


_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])


def _final_step(table: pa.Table, both: pa.Table, min_words: int, gram: int) -> pa.Table:
    """Kept words of each row and the removed spans (word offsets: start, end, start, ...)."""
    if not table.num_rows:
        return _RESULT.empty_table()
    part = _Part(table)
    kinds = np.array(both.column("kind").to_pylist(), np.int64)
    marks, verdicts = both.filter(pa.array(kinds == 0)), both.filter(pa.array(kinds == 1))
    records, waits, nodes = _local(part, marks, min_words, gram)
    gone = ~waits
    found = [np.frombuffer(b, "<u4") for b in verdicts.column("data").to_pylist()]
    if found:
        gone |= np.isin(nodes, nodes[np.isin(records["at"], np.concatenate(found))])
    step = np.zeros(len(part.hashes) + min_words + 1, np.int32)
    at = records["at"][gone].astype(np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + min_words, -1)
    removed = np.cumsum(step)[: len(part.hashes)] > 0
    n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), np.minimum(part.first[:-1], len(removed))) * (part.counts > 0)
    kept: list[bytes] = []
    for start, block in text_blocks(part.texts):
        kept += _join_kept(block, ~removed[part.first[start] : part.first[start + len(block)]])
    spans = [[] for _ in part.ids]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        while a < b:  # a run may cross rows
            row = part.row[a]
            end = min(b, part.first[row + 1])
            spans[row] += [int(a - part.first[row]), int(end - part.first[row])]
            a = end
    return pa.table([pa.array(part.ids, pa.int64()), pa.array(part.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], schema=_RESULT)


def _join_kept(block: list[bytes], keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    w = words_of(block)
    starts, ends = w.starts, w.ends
    out = w.buffer.copy()
    out[ends] = 0x20
    step = np.zeros(len(out) + 1, np.int8)
    step[starts[keep]] += 1
    step[ends[keep] + 1] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    sizes = np.concatenate([[0], np.cumsum((ends - starts + 1) * keep)])[w.first]
    data = out[mask].tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(sizes[:-1], sizes[1:])]


_COUNTS = "cell long, n long"


def _count_cells(batches, min_words: int):
    total = np.zeros(CELLS * (len(LEVELS) + 1), np.int64)
    for batch in batches:
        for _, block in text_blocks(batch.column(0).to_pylist()):
            w = words_of(block)
            doc = w.doc()
            m = max(0, len(w.hashes) - min_words + 1)
            inside = doc[:m] == doc[min_words - 1 : min_words - 1 + m]
            for cell in _prefix_cells(w.hashes, min_words):
                total[: CELLS * len(LEVELS)] += np.bincount(cell[:m][inside], minlength=CELLS * len(LEVELS))[: CELLS * len(LEVELS)]
            total[-1] += len(w.hashes)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["cell", "n"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, part_words: int = 1_000_000, group_suffixes: int = 2_000_000, gram: int | None = None) -> DataFrame:
    """Remove words covered by a ``min_words`` window that a document with a smaller id also has.

    Returns, for each input row: ``id``, ``n_words``, ``n_removed``, ``kept`` (UTF-8 bytes: kept
    words joined by one space) and ``spans`` (word offsets of the maximal removed runs).
    ``part_words`` bounds the words held by one task, ``group_suffixes`` the suffixes in one
    subtree; both are expected sizes, as parts and prefix cells are dealt by hash.
    """
    gram = gram or max(1, min(6, min_words // 2))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(functools.partial(_count_cells, min_words=min_words), _COUNTS).groupBy("cell").agg(F.sum("n").alias("n"))
    found = {r.cell: r.n for r in counts.collect()}  # at most CELLS * LEVELS + 1 rows, whatever the input
    n_words = found.pop(CELLS * (len(LEVELS) + 1) - 1, 0)
    groups = prefix_groups(found, group_suffixes)
    parts = max(1, -(-n_words // part_words))
    buckets = max(1, -(-n_words // (4 * part_words)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    docs_ = rows.groupBy("part")
    schema = "to long, part long, data binary"
    anchors = docs_.applyInArrow(lambda t: _anchor_step(t, min_words, gram, buckets), schema)
    marks = anchors.groupBy("to").applyInArrow(_shared_step, schema)
    suffixes = docs_.cogroup(marks.groupBy("to")).applyInArrow(lambda t, m: _suffix_step(t, m, min_words, gram, groups), schema)
    verdicts = suffixes.groupBy("to").applyInArrow(lambda t: _tree_step(t, min_words), schema)
    both = marks.withColumn("kind", F.lit(0)).unionByName(verdicts.withColumn("kind", F.lit(1)))
    return docs_.cogroup(both.groupBy("to")).applyInArrow(lambda t, m: _final_step(t, m, min_words, gram), "id long, n_words long, n_removed long, kept binary, spans array<long>")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    out = remove_repeats(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"), (F.size("spans") / 2).cast("int").alias("n_spans"))
