"""Near-duplicate documents by a chosen-path set similarity join.

After Christiani, Pagh & Sivertsen (2018): every set of word shingles is embedded as
``COORDINATES`` minwise tokens.  A tree starts from all documents; a node sends each of
its documents to one child for each coordinate that the node selects, named by the
document's token there, so documents of similarity s stay together with probability s
for each coordinate.  Nodes of at most ``small`` documents are compared exhaustively by
their tokens; from a larger node its smallest document is compared with all others, and
the node branches on: in the first round to 1 / threshold children on the mean, then to more
(``plan``), as a pair at the threshold would be lost with depth else.  There are ``trees`` independent
trees, two root coordinates each, or more where the threshold asks for it: a pair at the threshold whose
paths pass large nodes on all levels is missed with a probability of at most ``MISSED``, whatever the input's size.

Candidates are confirmed on the full sets.  As only classes are asked for, a link inside
a class already found adds nothing: each document is first confirmed against its
smallest candidate, and then only candidates of different classes are.  After each round
of ``levels`` the nodes whose documents have one class are finished (a dense group of near
copies).  A large node with at most ``node_pairs`` pairs of different classes, and after all rounds every one,
is compared exhaustively, block by block, on full sets; a task returns only as many links as join its classes.

Documents with the same set are one from the start, so copies are never paired.

A large node is dealt to as many tasks as its documents ask for, each with the node's smallest document, so a hot node is no
one task's.  Blocks are of bounded documents and shingles; they are compared by their tokens first, and only documents with a
partner there bring their texts.

Null and empty texts have an empty set and stay alone; null ids have a null component and are kept; rows of one id share its
component.  Other columns are not used.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import cut, heavy
from .words import U64, mix, pair_hash, shingle_sets, text_blocks

COORDINATES = 64
MISSED = 0.005  # of isolated pairs at the threshold, at most
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_SHIFTS = mix(_SEEDS)


def minwise_tokens(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over each set; 0 for empty sets."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                x = ((hashes * _SEEDS[k] + _SHIFTS[k]) >> U64(32)).astype(np.uint32)
                out[full, k] = np.minimum.reduceat(x, offsets[full])
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int, fold: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, block in text_blocks(texts, 1 << 20):
            hashes, offsets = shingle_sets(block, n, fold)
            tokens = minwise_tokens(hashes, offsets)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(h)])[offsets] for h in (mix(hashes), mix(hashes ^ U64(0x5851F42D4C957F2D)))]
            with np.errstate(over="ignore"):
                keys = np.stack([s[1:] - s[:-1] for s in sums], axis=1)
            count = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, len(block)), pa.array(count, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                names=["id", "n", "key", "tokens"],
            )


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return pair_hash(pair_hash(node, coordinate.astype(U64)), token.astype(U64)).view(np.int64)


def _roots(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Two root coordinates for each tree."""
    for batch in batches:
        tokens = _tokens(batch.column(1))
        for i in range(2 * trees):
            k = i * 7 % COORDINATES
            node = np.full(len(tokens), i // 2 + 1, U64)
            yield pa.RecordBatch.from_arrays([pa.array(_child(node, np.full(len(tokens), k), tokens[:, k])), batch.column(0)], names=["node", "id"])


def _least_matches(num: int, den: int) -> int:
    """Tokens that must agree: 5.5 standard deviations below the threshold."""
    s = num / den
    return int(COORDINATES * s - 5.5 * (COORDINATES * s * (1 - s)) ** 0.5)


def missed(threshold: float, trees: int, extra: list[float]) -> float:
    """Share of pairs at the threshold that no tree keeps together, over levels with these chances of a second child."""
    out = 0.0
    for k in range(COORDINATES + 1):  # tokens that agree
        s, stays = k / COORDINATES, 1.0
        for e in reversed(extra):
            stays = 1 - (1 - s * stays) * (1 - e * s * stays)
        out += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * (1 - s * stays) ** (2 * trees)
    return out


def plan(threshold: float, trees: int, levels: int, rounds: int) -> tuple[int, list[float]]:
    """Trees (these at least), and for each round a node's chance of a second child, that keep to ``MISSED``."""
    first = min(1.0, 1 / threshold - 1)
    for trees in range(trees, COORDINATES // 2 + 1):
        for later in np.arange(first, 1.02, 0.02):
            chances = [first] + [min(1.0, float(later))] * (rounds - 1)
            if missed(threshold, trees, [e for e in chances for _ in range(levels)]) <= MISSED:
                return trees, chances
    return trees, [1.0] * rounds


_STEP = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])


def _node_step(batches: Iterator[pa.RecordBatch], num: int, den: int, small: int, second: float) -> Iterator[pa.RecordBatch]:
    """Candidates (kind 0: a, b) and children (kind 1: node, id) of nodes, from rows sorted by node, salt, head and id.

    Small nodes are compared exhaustively.  Each part (salt) of a large node begins with a copy of the node's smallest
    document (head), which is compared with the others; these go to one or two children each, 1 + ``second`` of them on the mean.
    Only the last node's rows (or its head) are held from batch to batch.
    """
    least, held = _least_matches(num, den), None
    for batch in batches:
        new = pa.table({**{c: batch.column(c) for c in ("node", "salt", "id", "class", "n", "size", "tokens")}, "old": batch.column("head")})
        rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if not rows.num_rows:
            continue
        node, salt, ids, cls, n, size = (rows.column(c).to_numpy() for c in ("node", "salt", "id", "class", "n", "size"))
        old = rows.column("old").to_numpy(zero_copy_only=False) if isinstance(rows.column("old"), pa.Array) else rows.column("old").to_numpy()
        tokens = _tokens(rows.column("tokens"))
        start = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])]))
        run = np.repeat(start, np.diff(np.append(start, len(node))))
        tail = start[-1]
        whole = np.ones(len(node), bool)  # rows of nodes that are complete, or large
        if size[tail] <= small and len(node) - tail < size[tail]:
            whole[tail:] = False
            held = rows.slice(tail)
        elif size[tail] > small:
            held = rows.slice(tail, 1)
        else:
            held = None
        pairs = [(run, np.arange(len(node)), (size > small) & (run != np.arange(len(node))) & ~old)]
        for d in range(1, min(small, len(node))):
            pairs.append((np.arange(len(node) - d), np.arange(d, len(node)), (node[d:] == node[:-d]) & (size[d:] <= small) & whole[d:]))
        for i, j, may in pairs:
            i, j = i[may], j[may]
            may = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (cls[i] != cls[j])
            i, j = i[may], j[may]
            may = (tokens[i] == tokens[j]).sum(axis=1) >= least
            a, b = ids[i[may]], ids[j[may]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_STEP)
        go = np.flatnonzero((size > small) & ~old)
        name = node[go].view(U64)
        for turn in range(2):
            x = mix(name + U64(turn + 1))
            k = (x % U64(COORDINATES)).astype(np.int64)
            on = np.ones(len(x), bool) if turn == 0 else (x >> U64(40)) < U64(int(second * 2**24))
            child = _child(name, k + COORDINATES * turn, tokens[go, k])[on]
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(child), np.int32)), pa.array(child), pa.array(ids[go][on])], schema=_STEP)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs (left, right), by products of 0/1 matrices."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n[place] > 1
    _, place = np.unique(place[shared], return_inverse=True)
    owner = owner[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        x, y = np.searchsorted(place, [at, at + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[x:y], place[x:y] - at] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


_SIDES = pa.schema([("node", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64()), ("class", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary())])
_SIDES_SQL = "node long, lo int, hi int, id long, class long, block int, n long, tokens binary"


def _may_link(left: np.ndarray, right: np.ndarray, cls: np.ndarray, n: np.ndarray, tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows differ in class and are alike by size and tokens."""
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        agree += tokens[left, k][:, None] == tokens[right, k][None, :]
    may = (agree >= _least_matches(num, den)) & (cls[left][:, None] != cls[right][None, :])
    return may & (den * np.minimum(n[left][:, None], n[right][None, :]) >= num * np.maximum(n[left][:, None], n[right][None, :]))


def _block_sides(table: pa.Table, num: int, den: int) -> pa.Table:
    """The documents of two blocks (or one) that have a partner in the other one by their tokens."""
    cls, n, block, lo, hi = (table.column(c).to_numpy() for c in ("class", "n", "block", "lo", "hi"))
    left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    may = _may_link(left, right, cls, n, _tokens(table.column("tokens")), num, den)
    some = np.unique(np.concatenate([left[may.any(axis=1)], right[may.any(axis=0)]]))
    return table.take(pa.array(some)).select(_SIDES.names).cast(_SIDES)


def _block_links(table: pa.Table, shingle: int, fold: bool, num: int, den: int) -> pa.Table:
    """Links between two blocks of a node (or inside one), as few as join the same classes."""
    ids, cls, n, block, lo, hi = (table.column(c).to_numpy() for c in ("id", "class", "n", "block", "lo", "hi"))
    left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    sets: list[np.ndarray] = []
    for _, part in text_blocks(table.column("text").to_pylist(), 1 << 20):
        hashes, offsets = shingle_sets(part, shingle, fold)
        sets += [hashes[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
    size = np.array([len(v) for v in sets])
    both = _common(sets, left, right)
    linked = _may_link(left, right, cls, n, _tokens(table.column("tokens")), num, den)
    linked &= den * both >= num * (size[left][:, None] + size[right][None, :] - both)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked)):
        p, q = root(int(cls[left[i]])), root(int(cls[right[j]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[left[i]]), int(ids[right[j]])))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=_LINKS)


def _confirm(batches: Iterator[pa.RecordBatch], n: int, fold: bool, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full sets are similar enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(2).to_pylist() + part.column(3).to_pylist()
            sets: dict[str, np.ndarray] = {}
            order = list(dict.fromkeys(texts))
            for start, block in text_blocks(order, 1 << 20):
                hashes, offsets = shingle_sets(block, n, fold)
                sets |= {order[start + k]: hashes[offsets[k] : offsets[k + 1]] for k in range(len(block))}
            ok = []
            for a, b in zip(texts[: part.num_rows], texts[part.num_rows :]):
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            kept = part.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, shingle: int, fold: bool, num: int, den: int, small: int, trees: int, levels: int, rounds: int, node_pairs: int, block: int, node_rows: int, mean_n: int, key_rows: int):
        self.num, self.den, self.small, self.levels = num, den, small, levels
        self.rounds, self.node_pairs, self.block, self.node_rows, self.mean_n, self.key_rows = rounds, node_pairs, block, node_rows, mean_n, key_rows
        self.trees, self.second = plan(num / den, trees, levels, rounds)
        self.shingle, self.fold = shingle, fold
        self.texts_of = docs
        self.sketches = cut(docs.mapInArrow(functools.partial(_sketch, n=shingle, fold=fold), "id long, n long, key binary, tokens binary"))
        some = self.sketches.filter("n > 0 and id is not null")
        self.sets = cut(some.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("rows")))
        self.classes: DataFrame | None = None

    def _with_tokens(self, rows: DataFrame, on: str = "id", suffix: str = "") -> DataFrame:
        return rows.join(self.sets.select(F.col("id").alias(on), F.col("n").alias(f"n{suffix}"), F.col("tokens").alias(f"tokens{suffix}")), on)

    def _with_class(self, rows: DataFrame, on: str = "id", name: str = "class") -> DataFrame:
        if self.classes is None:
            return rows.withColumn(name, F.col(on))
        found = self.classes.select(F.col("id").alias(on), F.col("component").alias(name))
        return rows.join(found, on, "left").withColumn(name, F.coalesce(name, on))

    def _level(self, frontier: DataFrame, second: float) -> tuple[DataFrame, DataFrame]:
        """Candidates of one level and the next level's nodes."""
        nodes = self._open(frontier)
        parts = F.when(F.col("size") > self.small, F.ceil(F.col("size") / self.node_rows)).otherwise(1).cast("long")
        rows = self._of_nodes(frontier, nodes).select("node", "id", "class", "size", F.pmod(F.xxhash64("id"), parts).alias("salt"), F.lit(False).alias("head"))
        heads = nodes.filter(F.col("size") > self.small).select("node", F.col("least").alias("id"), F.col("least_class").alias("class"), "size", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"), F.lit(True).alias("head"))
        rows = self._with_tokens(rows.unionByName(heads)).select("node", "salt", "id", "class", "n", "size", "tokens", "head")
        rows = rows.repartition("node", "salt").sortWithinPartitions("node", "salt", F.desc("head"), "id")
        step = cut(rows.mapInArrow(functools.partial(_node_step, num=self.num, den=self.den, small=self.small, second=second), "kind int, x long, y long"))
        return step.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")), step.filter("kind = 1").select(F.col("x").alias("node"), F.col("y").alias("id"))

    def _open(self, frontier: DataFrame) -> DataFrame:
        """The nodes that have several classes: ``node, size, least`` (id) and its class."""
        rows = self._with_class(frontier)
        least = F.min(F.struct("id", "class"))
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high"), least.alias("x")).filter("low < high")
        return cut(nodes.select("node", "size", F.col("x.id").alias("least"), F.col("x.class").alias("least_class")))

    def _of_nodes(self, frontier: DataFrame, nodes: DataFrame) -> DataFrame:
        """The documents of these nodes: ``node, id, class, size``."""
        return self._with_class(frontier).join(nodes.select("node", "size").hint("merge"), "node").select("node", "id", "class", "size")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs that link; the pairs of an ``a`` that has many are dealt to several tasks, each with a copy of its text."""
        many = heavy(pairs.groupBy("a").agg(F.count("*").alias("n")), "n", self.key_rows).drop("n")
        copies = F.coalesce("copies", F.lit(1).cast("long"))
        a = self.texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(F.broadcast(many), "a", "left")
        a = a.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
        b = self.texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.join(F.broadcast(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("salt"))
        rows = rows.join(b, "b").join(a, ["a", "salt"]).select("a", "b", "text_a", "text_b")
        return rows.mapInArrow(functools.partial(_confirm, n=self.shingle, fold=self.fold, num=self.num, den=self.den), "a long, b long")

    def _link(self, pairs: DataFrame) -> None:
        """Confirm candidates of different classes and merge classes."""
        first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")))
        self._merge(self._confirmed(first))
        rest = self._with_class(self._with_class(pairs.join(first, ["a", "b"], "left_anti"), "a", "class_a"), "b", "class_b")
        self._merge(self._confirmed(cut(rest.filter("class_a <> class_b").select("a", "b"))))

    def _merge(self, links: DataFrame) -> None:
        """Classes after these links: components of the classes that they join."""
        ends = self._with_class(self._with_class(links, "a", "class_a"), "b", "class_b")
        joined = connected_components(ends, "class_a", "class_b")
        if self.classes is None:
            self.classes = joined
            return
        new = joined.select(F.col("id").alias("component"), F.col("component").alias("merged"))
        moved = self.classes.join(new, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))
        self.classes = cut(moved.unionByName(joined.join(self.classes, "id", "left_anti")))

    def run(self) -> DataFrame:
        frontier = self.sets.select("id", "tokens").mapInArrow(functools.partial(_roots, trees=self.trees), "node long, id long")
        for turn in range(self.rounds):
            found = None
            for _ in range(self.levels):
                pairs, frontier = self._level(frontier, self.second[turn])
                found = pairs if found is None else found.unionByName(pairs)
            pairs = cut(found.distinct())
            if turn == 0:
                ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(frontier.select("id")).distinct()
                self.texts = cut(self.texts_of.join(ends.hint("merge"), "id", "left_semi").distinct())  # ids grow with the corpus: never a broadcast
            self._link(pairs)
            left = cut(self._of_nodes(frontier, self._open(frontier)))
            work = cut(self._work(left))
            done = work if turn + 1 == self.rounds else work.filter(F.col("pairs") <= self.node_pairs)
            if not done.isEmpty():
                self._rest(left.join(done.hint("merge"), "node", "left_semi"))
            frontier = left.join(done.hint("merge"), "node", "left_anti").select("node", "id")
            if frontier.isEmpty():
                break
        return self._result()

    def _work(self, left: DataFrame) -> DataFrame:
        """``node, pairs``: pairs of different classes of each node."""
        sizes = left.groupBy("node", "class").agg(F.count("*").alias("n"))
        return sizes.groupBy("node").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))

    def _rest(self, left: DataFrame) -> None:
        """Exact: all pairs of different classes in these large nodes, in blocks of documents."""
        rows = self._with_tokens(left)
        load = rows.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / self.block, F.sum("n") / (self.block * self.mean_n))).cast("int").alias("blocks"))
        rows = rows.join(load, "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.select("node", "id", "class", "n", "tokens", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "class", "block", "n", "tokens")
        sides = functools.partial(_block_sides, num=self.num, den=self.den)
        rows = rows.groupBy("node", "lo", "hi").applyInArrow(lambda t: sides(t), _SIDES_SQL).join(self.texts, "id").select(*_SIDES.names, "text")
        step = functools.partial(_block_links, shingle=self.shingle, fold=self.fold, num=self.num, den=self.den)
        self._merge(rows.groupBy("node", "lo", "hi").applyInArrow(lambda t: step(t), "a long, b long"))

    def _result(self) -> DataFrame:
        """Class of each row by its set; rows without a set are in no join, and a set that many rows have reaches them by a broadcast."""
        named = cut(self._with_class(self.sets.select("key", "id", F.col("rows").alias("n")), "id", "class").select("key", "class", "n"))
        many = heavy(named, "n", self.key_rows).select("key", F.col("class").alias("heavy_class"))
        rows = self.sketches.select("id", "n", "key")
        full = rows.filter("n > 0 and id is not null").join(F.broadcast(many), "key", "left")
        common = full.filter("heavy_class is not null").select("id", "n", F.col("heavy_class").alias("component_id"))
        single = full.filter("heavy_class is null").join(named.select("key", "class"), "key").select("id", "n", F.col("class").alias("component_id"))
        bare = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
        out = common.unionByName(single).unionByName(bare).withColumnRenamed("n", "n_shingles")
        return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100), fold: bool = True, small: int = 24, trees: int = 6, levels: int = 3, rounds: int = 4, node_pairs: int = 5_000_000, block: int = 512, node_rows: int = 1024, mean_n: int = 2000, key_rows: int = 2048) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row.

    Rows are linked when ``threshold[1] * |A & B| >= threshold[0] * |A | B|`` over their sets of
    ``shingle``-word shingles (A-Z folded); a component is named by its smallest id, whose row is
    kept.  A text with fewer words is one shingle; null and empty texts have none and stay alone.  A row whose
    id is null has a null component and is kept.  Rows with one id share its component.
    A task takes ``node_rows`` documents of a large node, or two blocks of ``block`` documents with ``mean_n`` shingles on the mean; a document
    with over ``key_rows`` candidates, or a set that as many rows have, goes to several tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _Join(rows, shingle, fold, *threshold, small, trees, levels, rounds, node_pairs, block, node_rows, mean_n, key_rows).run()


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query: 3-word shingles at 0.85."""
    return near_duplicates(docs, shingle=3, threshold=(85, 100)).withColumnRenamed("id", "doc_id")
