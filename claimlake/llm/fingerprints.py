"""Bottom-k sketches of word shingles as document fingerprints.

A fingerprint holds the k smallest hashes of a text's distinct shingles (all of them, if
fewer), so equal texts have equal fingerprints, the union of two texts has the k smallest of both
(merging parts of a text or corpus), and resemblance, containment and the number of distinct
shingles can be estimated from fingerprints alone (Broder 1997; Beyer et al. 2007).

Null texts are empty, and empty texts have an empty fingerprint.  Rows are put in order by descending id, null ids last, and rows of one
id by a hash of their texts; equal rows each have their own place.  Other columns are not used.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64, shingle_sets, text_blocks

K = 128
SHINGLE = 5
MOST_PARTS = 1 << 20  # ranges of ids; the driver sees two ids of each


def sketches(texts: list, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text, ascending; null and empty texts have none."""
    out = []
    for _, block in text_blocks(texts, 1 << 20):
        hashes, offsets = shingle_sets(block, shingle)
        out += [hashes[a : min(b, a + k)] for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Fingerprint of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the part of the union's sketch that both hold; 1 for two empty sets."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for sets of fewer than k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b also has; 1 if a has none."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(U64)


def fingerprint(text: Column) -> Column:
    """Fingerprint column of a text column."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([encode(a) for a in sketches(texts.to_pylist())], pa.string())

    return of(text)


def _edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many of the start of ``after``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_distinct", pa.float64()), ("next_contains", pa.float64())])


def _compare(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows (id, text, next text) with their fingerprints compared."""
    edits = [_edited(t, n) for _, t, n in pairs]
    texts = list(dict.fromkeys([t for _, t, _ in pairs] + [n for _, _, n in pairs]))
    known = dict(zip(texts, sketches(texts)))
    own, other, edit = [known[t] for _, t, _ in pairs], [known[n] for _, _, n in pairs], sketches(edits)
    columns = [
        [i for i, _, _ in pairs], [len(t) for _, t, _ in pairs], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
        [encode(a) for a in own], [encode(a) for a in edit], [resemblance(a, b) for a, b in zip(own, edit)], [resemblance(a, b) for a, b in zip(own, other)],
        [distinct(a) for a in own], [containment(a, b) for a, b in zip(own, other)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _walk(batches: Iterator[pa.RecordBatch], block: int = 256, block_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, text, halo) by part and descending id; a part ends with its next one's first row (halo)."""
    waiting, pairs, chars = None, [], 0
    for batch in batches:
        for part, i, text, halo in zip(*(batch.column(k) for k in range(4))):
            part, i, text, halo = part.as_py(), i.as_py(), text.as_py() or "", halo.as_py()
            if waiting and waiting[0] == part:
                pairs.append((waiting[1], waiting[2], text))
                chars += len(waiting[2])
            waiting = None if halo else (part, i, text)
            if len(pairs) == block or chars > block_chars:
                yield _compare(pairs)
                pairs, chars = [], 0
    if pairs:
        yield _compare(pairs)


def _ranges(batches: Iterator[pa.RecordBatch], part_rows: int) -> Iterator[pa.RecordBatch]:
    """``low, high`` of runs of about ``part_rows`` ascending ids; equal ids are never parted."""
    low = high = None
    n = 0
    out: list[tuple[int, int]] = []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        while len(ids):
            if low is None:
                low, n = int(ids[0]), 0
            take = max(0, part_rows - n)
            if len(ids) <= take:
                high, n, ids = int(ids[-1]), n + len(ids), ids[:0]
                break
            high = int(ids[take - 1]) if take else high
            more = int(np.searchsorted(ids, high, "right"))
            if more == len(ids):
                n, ids = part_rows, ids[:0]
                break
            out.append((low, high))
            low, ids = None, ids[more:]
    if low is not None:
        out.append((low, high))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["low", "high"])


def with_next(docs: DataFrame, id_col: str, text_col: str, part_rows: int) -> DataFrame:
    """Rows (part, id, text, halo) in which each row is followed by the next by descending id.

    Parts are ranges of about ``part_rows`` ids, or more where there would be over ``MOST_PARTS``, found by a range exchange of the ids
    alone.  They are streamed, so their size is free.  The first row of a part also goes to the part before
    it, so one exchange brings texts and their successors together; the last row of all is followed by the first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = rows.select("id").count()
    ids = rows.select("id").filter("id is not null")
    part_rows = max(part_rows, -(-n // MOST_PARTS))
    found = ids.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(functools.partial(_ranges, part_rows=part_rows), "low long, high long").toArrow()
    lows, highs = (np.sort(found.column(c).to_numpy()) for c in ("low", "high"))
    of_null = rows.filter("id is null").agg(F.min(F.xxhash64("text"))).first()[0]  # the first row without an id
    last = 0 if of_null is None else -1

    @F.arrow_udf("long")
    def number(ids: pa.Array) -> pa.Array:
        i = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(lows, i, "right") - 1))

    @F.arrow_udf("long")
    def before(ids: pa.Array) -> pa.Array:
        """The part before the one that begins with this id, if one does."""
        i = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(highs, i).clip(max=max(0, len(highs) - 1))
        tops = ~ids.is_null().to_numpy(zero_copy_only=False) & (highs[at] == i if len(highs) else False)
        return pa.array(np.where(at + 1 < len(highs), at + 1, last), pa.int64(), mask=~tops)

    also = F.when(F.col("id").isNotNull(), before("id"))
    if of_null is not None:
        also = F.when(F.col("id").isNull() & (F.xxhash64("text") == of_null), F.lit(0 if len(lows) else -1)).otherwise(also)
    rows = rows.select("id", "text", number("id").alias("own"), also.cast("long").alias("also"))
    places = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("halo")), F.struct(F.col("also").alias("part"), F.lit(True).alias("halo")))
    rows = rows.select("id", "text", F.inline(places)).filter("part is not null")
    return rows.select("part", "id", "text", "halo").repartition("part").sortWithinPartitions("part", "halo", F.desc("id"), F.xxhash64("text"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 4096) -> DataFrame:
    """Fingerprint of each text and of its edited form, and how alike they are."""
    return with_next(docs, id_col, text_col, part_rows).mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, next_contains double")


def digest(docs: DataFrame) -> DataFrame:
    return compare_with_edit(docs)
