from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.llm import hard_negatives, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.5, 0.0, 0.0], 1), (903, [NAN, 1.0, 0.0, 0.0, 0.0], 2), (904, [1.0, -INF, 0.0, 0.0, 0.0], 2), (None, [0.5, 0.25, -0.5, 0.0, 0.1], 3)]


def vectors(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "s", 3) for r in rows], "vec_id long, embedding array<float>, label int, id int, x string, n int")


def random_rows(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    return [(i, (rng.normal(size=dim) @ mix / 4).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def whitened_plainly(rows, scale=256):
    """By id: deviation, and whitened values of the four main components; and the explained shares."""
    fine = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in fine})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    y = np.array([[Fraction(n * c - s) for c, s in zip(x, sums)] for x in listed], object)
    cov = np.array([[float(sum(y[:, i] * y[:, j]) / n**3) for j in range(len(sums))] for i in range(len(sums))])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ axes / np.sqrt(values)) for i, x in fine]
    return n, out, values / np.trace(cov)


def test_whitening_matches_a_plain_version(spark):
    rows = random_rows(200, 5)
    rows += rows[:20] + [(7, rows[0][1], 2)] * 60 + ODD
    n, want, explained = whitened_plainly(rows)
    got = whitening.digest(vectors(spark, rows)).toPandas()
    assert len(got) == 4 * len(want) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)
    key = lambda i: -1 if i is None or i != i else int(i)
    table = {}
    for r in got.itertuples():
        table.setdefault((key(r.vec_id), r.deviation), {})[r.component] = r.whitened
    signs = np.sign(np.array([table[key(want[0][0]), want[0][1]][c] for c in range(1, 5)]) * want[0][2])
    for i, deviation, w in want:
        assert np.allclose([table[key(i), deviation][c] for c in range(1, 5)], w * signs, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("scale", [256, 2**30, 2**50])
def test_covariance_is_exact_at_any_magnitude(spark, scale):
    """Squares in 64 bits, in parts, and in Python's integers."""
    rows = random_rows(60, 4, seed=2)
    n, _, explained = whitened_plainly(rows, scale)
    fit = whitening.fit(whitening.quantised(vectors(spark, rows), "embedding", scale=scale))[4]
    assert fit.n == n and np.allclose(fit.explained, explained, rtol=1e-12)


def test_squares_are_exact():
    rng = np.random.default_rng(3)
    for most in (100, 2**33, 2**45, 2**58):
        t = rng.integers(-most, most, (50, 3))
        hh, hl, ll = whitening.squares(t)
        assert [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*(np.broadcast_to(p, 3) for p in (hh, hl, ll)))] == [sum(int(v) ** 2 for v in c) for c in t.T]


def test_whitening_of_few_and_of_flat_vectors(spark):
    flat = [(i, [float(i % 3), 0.5, 0.0], 0) for i in range(9)]
    got = whitening.digest(vectors(spark, flat)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and {r.n for r in got} == {3}  # two dimensions have no variance
    assert whitening.digest(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    assert whitening.digest(vectors(spark, flat).limit(0)).count() == 0
    two = whitening.digest(vectors(spark, [*random_rows(20, 3), *[(100 + i, v, l) for i, v, l in random_rows(30, 2)]])).toPandas()
    assert sorted(two.groupby("n").size().to_dict().items()) == [(20, 60), (30, 60)]
    with pytest.raises(Exception, match="too large"):
        whitening.digest(vectors(spark, [(1, [1e30], 0), (2, [0.0], 0)])).collect()


def test_whitening_of_the_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    n, want, explained = whitened_plainly([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    got = whitening.digest(df).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    for i, _, w in want:
        assert np.allclose(np.abs(got.loc[i].to_numpy()), np.abs(w), atol=1e-8)
    assert np.allclose(whitening.digest(df).filter("vec_id = 0").orderBy("component").toPandas().explained, explained, rtol=1e-10)


def mined_plainly(rows, is_anchor, k=5, low=80, high=100, den=100):
    fine = [(i, l, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v, l in rows if l is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
    out = []
    for i, label, x in {(i, l, tuple(x)) for i, l, x in fine if i is not None and is_anchor(i)}:
        met = [(sum(a * b for a, b in zip(x, y)), j, l) for j, l, y in fine if j != i and len(y) == len(x)]
        for s, j, _ in first([m for m in met if m[2] == label]):
            window = [m for m in met if m[2] != label and low * s <= den * m[0] <= high * s]
            out += [(i, j, at + 1, n, s, t) for at, (t, n, _) in enumerate(first(window))]
    return sorted(out, key=str)


def clustered_rows(n, dim, centres, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 2
    return [(i, (middle[i % centres] + rng.normal(size=dim) / 8).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def same(row):
    return tuple(int(c) if c is not None else None for c in (row.anchor_id, row.positive_id, row.rank, row.negative_id, row.positive_score, row.negative_score))


@pytest.mark.parametrize("options", [{}, {"block_anchors": 4, "task_rows": 60}, {"positives": 2, "negatives": 2, "window": (7, 9, 8), "block_anchors": 9}])
def test_hard_negatives_match_brute_force(spark, options):
    rows = [(i, v, l) for i, v, l in clustered_rows(300, 6, 7)]
    rows += [(i + 1000, rows[0][1], 1) for i in range(80)] + rows[:12] + [(10, rows[3][1], 2), (20, rows[4][1], None), *ODD]
    got = hard_negatives.mine(hard_negatives.usable(vectors(spark, rows), "vec_id", "label", "embedding"), F.col("id") % 10 == 0, **options).collect()
    k, (low, high, den) = options.get("positives", 5), options.get("window", (80, 100, 100))
    want = mined_plainly(rows, lambda i: i % 10 == 0, k, low, high, den)
    assert sorted(map(same, got), key=str) == want and len(want) > 100


def test_hard_negatives_of_odd_tables(spark):
    rows = random_rows(90, 4) + [(500, [1.0, 2.0], 1), (502, [1.0, 2.5], 1), (503, [1.0, 2.0], 2), (600, [], 1), (601, [], 1), (602, [], 2)]
    mine = lambda df: hard_negatives.mine(hard_negatives.usable(df, "vec_id", "label", "embedding"), F.col("id") % 100 == 0)
    assert sorted(map(same, mine(vectors(spark, rows)).collect()), key=str) == mined_plainly(rows, lambda i: i % 100 == 0)
    assert hard_negatives.digest(vectors(spark, rows).limit(0)).count() == 0
    assert hard_negatives.digest(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor


def test_spanning_tree_passes_over_rows_and_loses_none():
    """Along the tree, few rows of far clusters are scored; what is found is what all products give."""
    rows = [(i, l, [int(c * 256) for c in v]) for i, v, l in clustered_rows(2000, 16, 12)]
    ids, labels, x = (np.array(c, np.int64) for c in zip(*rows))
    own = np.arange(0, 2000, 20)
    block = hard_negatives.Block.build(ids[own], labels[own], x[own], x[own[0]])
    assert all(np.flatnonzero(block.order == block.parent[at])[0] < np.flatnonzero(block.order == at)[0] for at in block.order[1:])
    state = hard_negatives.Positives(block, 5)
    work = sum(state.pack(ids[a : a + 500], labels[a : a + 500], x[a : a + 500]) for a in range(0, 2000, 500))
    assert work < 0.25 * len(own) * 2000  # of which a third has the anchor's label
    for at, i in enumerate(own):
        s = x @ x[i]
        met = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
        best = met[np.lexsort((ids[met], -s[met]))[:5]]
        assert state.best.id[at].tolist() == ids[best].tolist() and state.best.score[at].tolist() == s[best].tolist()


def test_scores_are_exact_at_any_magnitude():
    rng = np.random.default_rng(5)
    for most in (100, 2**27, 2**29, 2**30):
        x, a = rng.integers(-most, most, (20, 5)), rng.integers(-most, most, 5)
        assert hard_negatives.scores(x, a).tolist() == [sum(int(p) * int(q) for p, q in zip(r, a)) for r in x]
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 4), 2**31), np.full(4, 2**31))
