"""Toxic documents by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in the hashed terms (whole, and by their
first bytes, so that inflected forms are known) that it holds; a document's is the noisy-or of its sentences: one minus
the product of (1 - score).  Only documents have labels; the likelihood of these labels trains
the sentence scores, which then tell the offending sentences.

Training takes a bounded sample: ``per_class`` labelled ids of each class, by hash, with one row each (the smallest text).  Its
terms are counted by Spark in 2^21 hash buckets, the ``n_features`` (2,048, or as many as the sample has rows) with the strongest association are kept, of those whose
shares in the classes differ by a factor of e to the ``least_log_ratio`` or more, and the weights are fitted to the sample's sentences, which by then are short lists of them.  Scoring is one pass over all texts.

Nulls and empty texts have no sentence and score 0; equal texts have equal scores.  Labels that are null or
of held-out ids are not used, of different labels of one id the larger counts; if no class or only one is labelled, all scores are 0.
A kept column that has the score's name gives way to the score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import U64, text_blocks, words_of

BUCKETS = 1 << 21
BLOCK = 1 << 19  # bytes of text handled at a time
PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id's label is kept for testing: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Bags:
    """``sentence`` of each term, ``doc`` of each sentence, ``features`` of each term."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    features: np.ndarray


def bags(block: list[bytes]) -> Bags:
    w = words_of(block, fold=True, terms=True, prefixes=PREFIXES)
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return Bags(w.buffer, none, none, none, none, np.zeros((1 + len(PREFIXES), 0), np.int64))
    doc = w.doc()
    mark = np.cumsum(_ENDS[w.buffer])[w.starts]
    new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])
    features = (np.concatenate([w.hashes[None], w.prefixes]) & U64(BUCKETS - 1)).astype(np.int32)
    return Bags(w.buffer, w.starts, w.ends, np.cumsum(new) - 1, doc[new], features)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each feature, summed by task."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for start, block in text_blocks(batch.column(0).to_pylist(), BLOCK):
            b = bags(block)
            doc = b.doc[b.sentence]
            pairs = np.unique(np.concatenate([doc * BUCKETS + f.astype(np.int64) for f in b.features]))
            feature, label = pairs % BUCKETS, toxic[start + pairs // BUCKETS]
            found, which = np.unique(feature, return_inverse=True)
            n1 = np.bincount(which, weights=label, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n1), pa.array(np.bincount(which, minlength=len(found)) - n1)], names=["feature", "n1", "n0"])


def _selected(batches: Iterator[pa.RecordBatch], features: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each document: label, number of sentences, and (sentence, place of the feature) pairs."""
    for batch in batches:
        toxic = batch.column(1)
        for start, block in text_blocks(batch.column(0).to_pylist(), BLOCK):
            b = bags(block)
            place = np.searchsorted(features, b.features).clip(max=len(features) - 1)
            row, col = np.nonzero(features[place] == b.features)
            n_sentences = np.bincount(b.doc, minlength=len(block))
            first = np.concatenate([[0], np.cumsum(n_sentences)])
            sentence = b.sentence[col]
            doc = b.doc[sentence]
            order = np.argsort(doc, kind="stable")
            inner, place = (sentence - first[doc])[order], place[row, col][order]
            ends = np.searchsorted(doc[order], np.arange(len(block) + 1))
            both = np.stack([inner, place], axis=1).astype("<i4")
            lists = [both[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([toxic.slice(start, len(block)), pa.array(n_sentences, pa.int64()), pa.array(lists, pa.binary())], names=["toxic", "n", "pairs"])


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.features] = self.weights
        return out


def fit(toxic: np.ndarray, n_sentences: np.ndarray, pairs: list[np.ndarray], n_features: int, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Maximum likelihood of document labels under the noisy-or, by Adam on the whole sample."""
    base = np.concatenate([[0], np.cumsum(n_sentences)])
    sentence = np.concatenate([p[::2] + base[i] for i, p in enumerate(pairs)]) if pairs else np.zeros(0, int)
    place = np.concatenate([p[1::2] for p in pairs]) if pairs else np.zeros(0, int)
    code = np.unique(sentence * n_features + place)
    sentence, place = code // n_features, code % n_features
    some, row = np.unique(sentence, return_inverse=True)  # sentences with features; the others only have the bias
    doc = np.searchsorted(base, some, "right") - 1
    plain = n_sentences - np.bincount(doc, minlength=len(toxic))
    class_weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = -6.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[place], minlength=len(some)) + w[-1]
        soft, p = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        soft0, p0 = np.logaddexp(0, w[-1]), 1 / (1 + np.exp(-w[-1]))
        total = np.bincount(doc, weights=soft, minlength=len(toxic)) + plain * soft0
        pull = np.where(toxic == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * class_weight
        g_s = pull[doc] * p
        g = np.append(np.bincount(place, weights=g_s[row], minlength=n_features), g_s.sum() + (pull * plain * p0).sum())
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, n_features: int | None = None, least_log_ratio: float = 1.0) -> Model | None:
    """Fit to at most ``per_class`` labelled rows of each class that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most 2 * per_class rows, hence the broadcast
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), F.col("id") == F.col("doc_id"))
    sample = cut(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))  # one row for each id
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n_features = n_features or max(2048, sum(sizes.values()))
    counts = sample.mapInArrow(_counts, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    r1, r0 = (F.col("n1") + 0.5) / (sizes[1] + 1.0), (F.col("n0") + 0.5) / (sizes[0] + 1.0)
    strength = F.abs(F.log(r1 / r0)) * F.sqrt(F.col("n1") + F.col("n0"))
    best = counts.filter((F.col("n1") + F.col("n0") >= 3) & (F.abs(F.log(r1 / r0)) >= least_log_ratio)).orderBy(strength.desc(), "feature").limit(n_features).select("feature").collect()
    if not best:
        return None
    features = np.sort(np.array([r.feature for r in best], np.int64))
    rows = sample.mapInArrow(functools.partial(_selected, features=features), "toxic long, n long, pairs binary").toArrow()  # bounded by the sample
    toxic, n, pairs = rows.column("toxic").to_numpy(), rows.column("n").to_numpy(), rows.column("pairs").to_pylist()
    order = sorted(range(len(pairs)), key=lambda i: (toxic[i], n[i], pairs[i]))  # sums do not depend on how rows arrive
    weights, bias = fit(toxic[order], n[order], [np.frombuffer(pairs[i], "<i4").astype(np.int64) for i in order], len(features))
    return Model(features, weights, bias)


def _score(batches: Iterator[pa.RecordBatch], model: Model | None, sentences: bool, text_at: int, n_keep: int, name: str) -> Iterator[pa.RecordBatch]:
    table = model.table() if model else None
    for batch in batches:
        for start, block in text_blocks(batch.column(text_at).to_pylist(), BLOCK):
            b = bags(block)
            z = np.full(len(b.doc), model.bias if model else -np.inf)
            if model:
                hits = table[b.features]
                row, col = np.nonzero(hits)
                code = np.unique(b.sentence[col] * BUCKETS + b.features[row, col].astype(np.int64))  # each feature once a sentence
                z += np.bincount(code // BUCKETS, weights=table[code % BUCKETS], minlength=len(z))
            total = np.bincount(b.doc, weights=np.logaddexp(0, z), minlength=len(block))
            columns = [batch.column(k).slice(start, len(block)) for k in range(n_keep)]
            names = batch.schema.names[:n_keep]
            score = pa.array(np.abs(np.expm1(-total)), pa.float64())
            if not sentences:
                yield pa.RecordBatch.from_arrays([*columns, score], names=[*names, name])
                continue
            found: list[list] = [[] for _ in block]
            raw = b.buffer.tobytes()
            for s in np.flatnonzero(z >= 0):
                a, after = np.searchsorted(b.sentence, [s, s + 1])
                found[b.doc[s]].append({"sentence": raw[b.starts[a] : b.ends[after - 1]].decode("utf-8", "replace"), "score": float(1 / (1 + np.exp(-z[s])))})
            yield pa.RecordBatch.from_arrays([*columns, score, pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))], names=[*names, name, "offending"])


def scored(docs: DataFrame, model: Model | None, keep: list[str], sentences: bool = False, name: str = "score") -> DataFrame:
    """``keep``, the score as ``name`` and, if asked for, ``offending`` (sentences of at least one half) of each row."""
    keep = [c for c in keep if c.lower() != name.lower() and not (sentences and c.lower() == "offending")]
    chosen = [F.col(f"`{c}`") for c in keep]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*chosen).schema]
    at = keep.index("text") if "text" in keep else len(keep)
    rows = docs.select(*chosen) if "text" in keep else docs.select(*chosen, "text")
    schema = ", ".join([*kept, f"`{name}` double", *(["offending array<struct<sentence:string,score:double>>"] if sentences else [])])
    return rows.mapInArrow(functools.partial(_score, model=model, sentences=sentences, text_at=at, n_keep=len(keep), name=name), schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    rows = scored(docs, train(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
