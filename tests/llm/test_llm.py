import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlake.llm import fingerprints, line_dedup, mixing, near_dedup, pseudonyms, queries, sampled_pieces, substring_dedup, token_files, toxicity, vp_search
from claimlake.llm.words import U64
from tests.duck import assert_same, connect

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n"), (None, "a b c d e f g"), (None, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "A b c d e f g"), (6, "x")]


def frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, id int, score string")


def empty(spark):
    return frame(spark, ODD).limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], connect(SF))


@pytest.mark.parametrize("options", [{}, {"part_words": 60, "group_suffixes": 6}])
def test_substring_dedup_matches_brute_force(spark, options):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.choice([0, 3, 9, 30])))) for i in range(60)]
    rows += rows[:5] + ODD
    for window in (1, 5, 13):
        out = substring_dedup.remove_repeats(frame(spark, rows), min_words=window, **options).collect()
        assert sorted([(r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out], key=str) == brute.substring_dedup(rows, window)
        assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in out)
    assert substring_dedup.digest(empty(spark)).count() == 0


def test_substring_dedup_finds_repeats_by_its_trees(monkeypatch):
    """One part, so all repeats lie inside it: without the trees' nodes none is found."""
    texts = [" ".join(f"{'ab'[i % 2]}{k}" for k in range(30)) for i in range(6)]
    table = pa.table({"id": pa.array(range(6), pa.int64()), "text": texts, "part": pa.array([0] * 6, pa.int64())})
    none = pa.table({"to": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "data": pa.array([], pa.binary()), "kind": pa.array([], pa.int32())})
    removed = lambda: substring_dedup._final_step(table, none, 13, 6).column("n_removed").to_pylist()
    assert removed() == [0, 0, 30, 30, 30, 30]
    tree = substring_dedup.Subtree(substring_dedup._suffixes(substring_dedup._Part(table), np.array([0, 60, 30, 1]), 13), 13)
    assert sorted(tree.depth.tolist()) == [0, 0, 13] and len(np.unique(tree.nodes(13))) == 3
    monkeypatch.setattr(substring_dedup.Subtree, "nodes", lambda self, depth: np.arange(len(self.order)))
    assert removed() == [0] * 6


def test_substring_dedup_of_a_long_text_and_a_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"u{i} {passage} v{i}") for i in range(300)] + [(1000, " ".join(f"w{i % 997}" for i in range(40_000)))]
    out = substring_dedup.remove_repeats(frame(spark, rows), part_words=1500, group_suffixes=500).collect()
    assert {r.id: r.n_removed for r in out} == {0: 0, 1000: 0, **{i: 20 for i in range(1, 300)}}


@pytest.mark.parametrize("options", [{}, {"small": 4, "rounds": 2, "block": 8, "node_rows": 3, "mean_n": 5, "key_rows": 2}])
def test_near_dedup_matches_brute_force(spark, options):
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(base[rnd.choice([0, 0, 0, rnd.randrange(6)])])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(60)] = rnd.choice("xyz") + str(rnd.randrange(1000))
        rows.append((i + 10, " ".join(w)))
    rows += rows[:3] + ODD
    out = near_dedup.near_duplicates(frame(spark, rows), shingle=3, threshold=(85, 100), **options)
    assert sorted(map(tuple, out.collect()), key=str) == brute.near_dedup(rows, 3, 85)


def test_near_dedup_finishes_nodes_one_by_one(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        w = [f"w{k}" for k in range(60)]
        for _ in range(rnd.choice([1, 2, 5, 6])):
            w[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for most in (0, 60, 2000):
        out = near_dedup.near_duplicates(frame(spark, rows), shingle=3, threshold=(85, 100), small=3, rounds=3, levels=1, node_pairs=most, block=16)
        assert sorted(map(tuple, out.collect()), key=str) == brute.near_dedup(rows, 3, 85)


@pytest.mark.parametrize("num", [80, 85])
def test_near_dedup_keeps_threshold_pairs_together_at_any_depth(num):
    """Isolated pairs at the threshold, whose nodes are all large: the share that no path keeps together."""
    rng, pairs, levels = np.random.default_rng(1), 500, 12
    trees, chances = near_dedup.plan(num / 100, 6, 3, 4)
    fresh = lambda: rng.integers(0, 2**32, (pairs, near_dedup.COORDINATES)).astype(np.uint32)
    a = fresh()
    tokens = np.stack([a, np.where(rng.random(a.shape) < num / 100, a, fresh())], axis=1).reshape(2 * pairs, -1)
    blobs = np.array([t.tobytes() for t in tokens], object)

    def together(batches, columns):
        node, ids = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in columns)
        order = np.lexsort((ids, node))
        node, ids = node[order], ids[order]
        same = (node[1:] == node[:-1]) & (ids[1:] // 2 == ids[:-1] // 2) & (ids[1:] != ids[:-1])
        hit = np.append(same, False) | np.append(False, same)
        return node[hit], ids[hit]

    start = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * pairs)), pa.array(blobs.tolist(), pa.binary())], names=["id", "tokens"])
    node, ids = together(list(near_dedup._roots(iter([start]), trees)), (0, 1))
    for k in range(levels):
        columns = [node, np.zeros(len(ids), np.int64), ids, ids, np.full(len(ids), 100), np.full(len(ids), 1_000_000), np.zeros(len(ids), bool)]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs[ids].tolist(), pa.binary())], names=["node", "salt", "id", "class", "n", "size", "head", "tokens"])
        steps = near_dedup._node_step(iter([batch]), num, 100, 24, second=chances[k // 3])
        node, ids = together([b.filter(pa.array(b.column("kind").to_numpy() == 1)) for b in steps], (1, 2))
    assert 1 - len(np.unique(ids // 2)) / pairs <= 2 * near_dedup.MISSED


def test_near_dedup_deals_hot_sets_and_families(spark):
    """A third of the rows are copies, a third near copies of one text, some empty; and a very long text with its near copy."""
    rnd, words = random.Random(5), [f"w{i}" for i in range(80)]
    near = lambda: " ".join(words[:k] + [f"x{rnd.randrange(10**6)}"] + words[k + 1 :]) if (k := rnd.randrange(80)) else ""
    rows = [(i, " ".join(words)) for i in range(60)] + [(100 + i, near()) for i in range(60)] + [(200 + i, " ".join(rnd.sample(words, 30))) for i in range(40)] + [(300 + i, "") for i in range(20)]
    long = [f"l{i}" for i in range(30_000)]
    rows += [(400, " ".join(long)), (401, " ".join(long[:-50]))]
    out = near_dedup.near_duplicates(frame(spark, rows), shingle=3, threshold=(85, 100), key_rows=8, small=4, node_rows=8, block=16)
    assert sorted(map(tuple, out.collect()), key=str) == brute.near_dedup(rows, 3, 85)


def test_near_dedup_of_no_rows(spark):
    assert near_dedup.digest(empty(spark)).count() == 0


def test_toxicity_finds_held_out_documents_and_sentences(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model, ["doc_id"]).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in out)
    assert len(out) > 50 and right / len(out) > 0.9
    odd = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([(1, None), (2, ""), (3, "an idiot and a clown. fine words.")], "doc_id long, text string"), model, ["doc_id"], sentences=True).collect()}
    assert odd[1].score == odd[2].score == 0 and odd[3].score > 0.5 and odd[3].offending[0].sentence == "an idiot and a clown"
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.digest(empty(spark), labels).count() == 0


def test_toxicity_scores_match_a_plain_noisy_or(spark):
    """A document's score from the fitted weights: one minus the product over its sentences of one minus their logistic scores; long and repeated rows, a column called score."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert model is not None
    text = "fine words here. an idiot and a clown! more words? " * 3
    rows = [(1, text), (1, text), (2, "plain words. " * 20_000), (3, None), *[(10 + r.doc_id, r.text) for r in docs.limit(40).collect()]]
    out = toxicity.scored(frame(spark, rows), model, ["doc_id", "id", "score"], sentences=True).collect()
    for r, (i, t) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0])):
        assert r.doc_id == i and r.id == 7 and abs(r.score - brute.noisy_or(t, toxicity.bags, model)) < 1e-4


def test_mixing_matches_a_plain_version(spark):
    """Sources that reach three times their size, a null one, one without words; repeated rows, a very long text."""
    rows = [(i, "w " * (1 + i % 9), ["a", "b", "c", "d", None][min(i % 11, 4)]) for i in range(600)]
    rows += rows[:9] + [(900, None, "e"), (901, "", "e"), (902, "x" * 400_000, "f"), (903, "long " * 90_000, "g"), (None, "p q", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_copies int")
    target, want = brute.mixing(rows)
    got = mixing.digest(df).collect()
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=str) == sorted(((i, n, n * k) for i, n, k in want), key=str)
    assert all(abs(r.target - target[s]) <= 1e-9 * max(1.0, target[s]) for r in got for s in [next(o for i, _, o in rows if i == r.doc_id)])


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4]) for i in range(2000)] + [(5000, None, "d"), (None, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.with_copies(df)
    total = out.agg(F.sum("mix_size")).first()[0]
    by = {r.source: r for r in out.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target"), F.max("mix_copies").alias("most")).collect()}
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 * total
    assert all(abs(r.taken - r.target) <= 0.15 * r.target + 20 and r.most <= 3 for r in by.values())
    assert mixing.mixed(df).count() == out.agg(F.sum("mix_copies")).first()[0] and mixing.mixed(df).columns == df.columns
    assert mixing.with_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}, {"most_broadcast": 0, "host_pages": 2}])
def test_line_dedup_odd_rows(spark, options):
    rows = [(i, "h" if i < 8 else None, None if i == 3 else f"common\t x\nx{i}\n\n a ") for i in range(12)] + [(20, "z", ""), (21, "z", "only"), (21, "z", "only")]
    df = spark.createDataFrame([(*r, 1, "n", 5, "d") for r in rows], "doc_id long, host string, text string, line_host int, names string, lines_seen int, salt string")
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, "host", "text", **options).collect()}
    assert out[0].text == "x0\n" and out[9].text == "x9\n" and out[3].text is None and out[20].text == "" and out[21].text == "only"
    assert (out[0].lines_seen, out[0].lines_dropped, out[3].lines_seen, out[0].line_host, out[0].names, out[0].salt) == (4, 2, 0, 1, "n", "d")
    plain = line_dedup.drop_boilerplate(df, "host", "text", counts=False, **options)
    assert plain.columns == df.columns and plain.count() == len(rows) and plain.first().lines_seen == 5
    assert line_dedup.drop_boilerplate(df.limit(0), "host", "text").count() == 0


def test_line_dedup_query_of_odd_pages_matches_sql(spark, tmp_path):
    html = "<p>menu\tbar</p><SCRIPT>x</SCRIPT><style >y</style><!-- z --><b>own %d</b><script>open"
    rows = [(i, None if i % 3 == 0 else "HTTP://u@Host.x:80/a", html % i) for i in range(12)] + [(20, "http://y", None), (21, "http://y", ""), (22, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert_same(line_dedup.digest(spark.read.parquet(f"{tmp_path}/pages")), line_dedup.SQL, con)


def nearest(rows, k=20):
    """Brute force with sums in the order of the components."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[:, j] * x[q, j]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize("shard_rows, block_rows, task_queries", [(300, 20, 16_384), (16, 7, 10), (4096, 512, 16_384)])
def test_vp_search_recall_and_odd_vectors(spark, shard_rows, block_rows, task_queries):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 16)) * 3
    vectors = (centres[rng.integers(0, 9, 900)] + rng.normal(size=(900, 16))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900 + i, vectors[20]) for i in range(30)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (None, vectors[0]), (2060, [None] * 16), (2080, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd + [rows[40]], "vec_id long, embedding array<double>").repartition(5)
    use, want = vp_search.usable(df, "vec_id", "embedding"), nearest(rows + [rows[40]])
    for factor in (1.0, 1.1):
        got = vp_search.search(vp_search.build_index(use, shard_rows), use.filter("id % 20 = 0"), 20, factor, block_rows, task_queries).orderBy("query_id", "rank").collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r["rank"] == len(found[r.query_id])
        if factor == 1.0:
            assert found == want  # scores and ties included
        assert sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert vp_search.digest(df.limit(0)).count() == 0


def test_vp_search_scores_do_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64))
    x[300:400] = x[3]
    tree = vp_search.Tree(np.arange(700), x, float(np.sqrt((x * x).sum(axis=1)).max()))
    whole = tree.search(np.full(40, -1), x[:40], 30, 1.0)
    for at in range(40):
        one = tree.search(np.array([-1]), x[at : at + 1], 30, 1.0)
        assert np.array_equal(one[0][0], whole[0][at]) and np.array_equal(one[1][0], whole[1][at])
    assert whole[0][3].tolist() == [3, *range(300, 329)]


def test_fingerprints(spark):
    a, b = ("a b c d e f g h " * 3).split(), "k l m n o p".split()
    x, y = fingerprints.sketches([" ".join(a), " ".join(a + b)])
    assert fingerprints.resemblance(x, x) == 1 and 0 < fingerprints.resemblance(x, y) < 1 and fingerprints.containment(x, y) == 1
    assert fingerprints.resemblance(*fingerprints.sketches([None, ""])) == 1
    many = fingerprints.sketches([" ".join(map(str, range(5000)))])[0]
    assert 0.7 < fingerprints.distinct(many) / 4996 < 1.3 and np.array_equal(fingerprints.decode(fingerprints.encode(many)), many)
    assert fingerprints.digest(empty(spark)).count() == 0


def true_jaccard(a, b):
    def shingles(t):
        w = brute.WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0, len(x | y)


@pytest.mark.parametrize("part_rows", [1, 2, 4096])
@pytest.mark.parametrize("which", ["odd", "without null ids", "only null ids"])
def test_fingerprint_query_matches_brute_force(spark, which, part_rows):
    rnd = random.Random(9)
    words = lambda n: " ".join(f"w{rnd.randrange(60)}" for _ in range(n))
    rows = [*ODD, (9, "é😀" * 50), (-3, words(300)), (7, words(2000)), (7, words(40)), (7, None), (8, words(3))]
    rows += [(20 + i, words(60)) for i in range(8)]
    rows = [r for r in rows if which == "odd" or (r[0] is None) == (which == "only null ids")]
    docs = frame(spark, rows)
    order = docs.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).select("doc_id", "text").collect()
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)].text or ""
        cut = len(t) // 3
        edit = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), t, edit, after))
    got = fingerprints.compare_with_edit(docs, part_rows=part_rows).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    known = {}
    for *key, text, edit, after in want:
        r = by[tuple(key)]
        assert known.setdefault(text, r.fingerprint) == r.fingerprint and known.setdefault(edit, r.edited_fingerprint) == r.edited_fingerprint
        for near, other in ((r.near_edited, edit), (r.near_next, after)):
            true, n = true_jaccard(text, other)
            if near != true or n > fingerprints.K:
                assert n > fingerprints.K and abs(near - true) < 5 * (max(true * (1 - true), 0.01) / fingerprints.K) ** 0.5


def test_token_files_round_trip(spark):
    texts = ["", "a  b", "x  y", "tail ", "naïve café", "<|endoftext|> z", "\n\n q", "don't we'll 12345"]
    rows = list(enumerate(texts)) + [(100, None)]
    tokenizer = token_files.PieceEncoder(token_files.default_tokenizer()).tokenizer
    at, want = 0, []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.digest(frame(spark, rows)).collect())) == want
    assert token_files.digest(empty(spark)).count() == 0
    bad = bytearray(token_files.frame(b"payload"))
    bad[14] ^= 1
    with pytest.raises(ValueError):
        token_files.unframe(bytes(bad))


def encoded_plainly(rows):
    """Contract rows of op7 from the library's own encoder, a text at a time; rows of one id in the order of their files' hashes."""
    tokenizer = token_files.PieceEncoder(token_files.default_tokenizer()).tokenizer
    at, out = 0, []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, token_files.digest(docs).collect())) == encoded_plainly(rows)


def test_token_files_roll_over_and_keep_odd_rows(spark):
    """Null ids first, rows of one id by the hash of their texts, a long text; a new file after every few hundred bytes."""
    rows = [*ODD, (50, "long text with many words " * 30_000), *[(60 + i, f"text {i}") for i in range(40)]]
    df = frame(spark, rows)
    order = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    folder = token_files.shared_path(spark, "tokens")
    files = token_files.cut(token_files.write_token_files(df, folder, file_bytes=300))
    assert files.count() >= 5
    got = sorted(map(tuple, token_files.read_token_files(files, folder).collect()), key=lambda r: r[1])
    assert got == encoded_plainly(order)


def test_pseudonyms_keep_format_and_links():
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", backward=True)
    for text in ["call +1 (743) 555-3824", "card 4994226020900891.", "at 70.23.22.57", "on 1984-02-29", "to ing.19@mail5.example.com", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789"]:
        new, kinds = pseudonyms.pseudonymised(text, names)
        assert new != text and len(kinds) == 1 and pseudonyms.pseudonymised(text, names)[0] == new
        assert pseudonyms.pseudonymised(new, back)[0] == text
    assert pseudonyms.pseudonymised("1234567890123456 2020-13-01 999.1.1.1", names)[1] == []
    p = pseudonyms.Permutation(b"k", "d", 997)
    assert sorted(map(p.forward, range(997))) == list(range(997)) and all(p.backward(p.forward(i)) == i for i in range(997))


def many_values(rnd):
    """Valid values of every format, with what must hold for a pseudonym."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for _ in range(1500):
        rest = digits(18)
        whole = "DE" + pseudonyms.iban_digits("DE", rest) + rest
        yield rnd.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 22, 4))]), "iban"
        rest = "NWBK" + digits(14)
        yield "GB" + pseudonyms.iban_digits("GB", rest) + rest, "iban"
        card = rnd.choice("3456") + digits(14)
        card += pseudonyms.luhn_digit(card)
        yield rnd.choice([card, "-".join(card[i : i + 4] for i in range(0, 16, 4))]), "card"
        y, m, d = rnd.randint(1900, 2099), rnd.randint(1, 12), rnd.randint(1, 28)
        yield rnd.choice([f"{y}-{m:02d}-{d:02d}"]), "date_iso"
        yield rnd.choice([f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{m}/{rnd.randint(13, 28)}/{y}"]), "date_day_first"
        yield f"{rnd.choice('ab')}{digits(rnd.randint(1, 4))}.{digits(3)}-{digits(3)}-{digits(4)}@mail{digits(1)}.example.com", "email"
        yield f"{digits(3)}-{digits(3)}-{digits(4)}@mail.com", "email"
        yield ".".join(str(rnd.randint(0, 255)) for _ in range(4)), "ip"
        yield f"({rnd.randint(2, 9)}{digits(2)}) {rnd.randint(2, 9)}{digits(2)}-{digits(4)}", "phone"
        yield f"{rnd.randint(100, 599)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", "ssn"


def test_pseudonyms_are_valid_linked_and_reversible():
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", backward=True)
    seen: dict[str, str] = {}
    for value, kind in many_values(random.Random(8)):
        text = f"see {value} and {value}, THEN"
        new, kinds = pseudonyms.pseudonymised(text, names)
        assert kinds == [kind, kind], text
        own = new[4 : new.index(" and ", 4)]
        assert new == f"see {own} and {own}, THEN" and seen.setdefault(value, own) == own
        assert pseudonyms.pseudonymised(new, back)[0] == text
        if kind != "ip":
            assert [c.isdigit() for c in own] == [c.isdigit() for c in value]
        if kind == "iban":
            bare = own.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        if kind == "card":
            bare = own.replace("-", "")
            assert pseudonyms.luhn_digit(bare[:-1]) == bare[-1]
    assert len(set(seen.values())) == len(seen)
    with pytest.raises(ValueError):
        pseudonyms.Pseudonyms(b"")


def test_pseudonyms_of_spaced_ibans_end_at_their_country():
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", backward=True)
    text = "pay BE71 0961 2345 6769 SOON or XX00 4994 2260 2090 0891, 4994226020900891"
    new, kinds = pseudonyms.pseudonymised(text, names)
    assert kinds == ["iban", "card", "card"] and " SOON or XX00 " in new and pseudonyms.pseudonymised(new, back)[0] == text


def test_pseudonyms_of_whole_tables_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = pseudonyms.digest(docs)
    back = pseudonyms.pseudonymise(out, ["doc_id"], pseudonyms.QUERY_KEY, backward=True)
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 and back.count() == docs.count()
    for r in out.join(docs.withColumnRenamed("text", "old"), "doc_id").collect():
        found = pseudonyms.values(r.old, pseudonyms.Pseudonyms(pseudonyms.QUERY_KEY))
        assert r.n_replaced == len(found) == len(r.kinds) and sorted(k for _, _, k, _ in found) == r.kinds
        plain = brute.personal_values(r.old)
        assert plain <= {r.old[a:b] for a, b, _, _ in found}, plain
        assert (r.text == r.old) == (not found)


def test_pseudonyms_of_odd_rows(spark):
    rows = {r.doc_id: r for r in pseudonyms.digest(frame(spark, [(1, None), (2, ""), (3, "x" * 500_000 + "@"), (4, "9" * 300_000)])).collect()}
    assert rows[1].text is None and rows[1].n_replaced == 0 and rows[2].text == "" and rows[3].n_replaced == rows[4].n_replaced == 0
    out = pseudonyms.pseudonymise(spark.createDataFrame([(1, "on 1984-02-29", "k")], "doc_id long, text string, Kinds string"), ["doc_id", "text", "Kinds"], b"k")
    assert out.columns == ["doc_id", "text", "kinds"] and out.first().kinds == ["date_iso"]
    assert pseudonyms.digest(frame(spark, ODD)).count() == len(ODD) and pseudonyms.digest(empty(spark)).count() == 0


def test_sampled_pieces_are_lossless_and_follow_the_weights(spark):
    out = sampled_pieces.encode(frame(spark, [*ODD, (50, "▁ x ▁▁\t中文 😀 " + "q" * 300)]))
    assert all(r.lossless for r in out.collect()) and out.filter("doc_id = 1 or doc_id = 2").agg(F.sum("n_pieces")).first()[0] == 0
    assert out.orderBy("doc_id", "n_pieces").collect() == out.repartition(3).orderBy("doc_id", "n_pieces").collect()
    assert sampled_pieces.decode(out).filter("doc_id = 50").first().text.startswith("▁ x ▁▁\t中文")
    lattice = sampled_pieces.Lattice(sampled_pieces.default_model())
    ids, counts = lattice.sample([b"thing"] * 20_000, np.arange(20_000).astype(U64))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[e - n : e]) for n, e in zip(counts, ends))
    weight = {lattice.pool[lattice.begin[i] : lattice.begin[i] + n].tobytes(): (i, w) for n, (_, ids_, ws) in lattice.by_length.items() for i, w in zip(ids_, ws)}

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, w in paths(s[k:]):
                    yield (weight[s[:k]][0], *rest), w * weight[s[:k]][1]

    shares = dict(paths(b" thing"))
    total = sum(shares.values())
    assert set(got) <= set(shares) and all(abs(got[p] / 20_000 - w / total) < 0.015 for p, w in shares.items())


def test_sampled_pieces_of_long_chunks(monkeypatch):
    lattice, rnd = sampled_pieces.Lattice(sampled_pieces.default_model()), random.Random(2)
    texts = ["".join(rnd.choice("aehnrstioéü中▁😀xQ9") for _ in range(n)).encode()[:62].decode("utf-8", "ignore").encode() for n in range(20, 60)]
    keys = np.arange(len(texts)).astype(U64)
    short = lattice.sample(texts, keys)
    monkeypatch.setattr(sampled_pieces, "LONG", 0)
    monkeypatch.setattr(sampled_pieces, "WINDOW", 7)
    assert all(np.array_equal(a, b) for a, b in zip(short, lattice.sample(texts, keys)))  # the same draws by windows
    assert lattice.decode(*lattice.sample(texts, keys)) == texts


def test_sampled_pieces_of_a_text_without_a_space(spark):
    text = ("naïve中文😀" + "abcdefgh" * 40) * 1500  # half a megabyte
    out = sampled_pieces.encode(spark.createDataFrame([(1, text), (2, "q" * 300_000)], "doc_id long, text string")).collect()
    assert all(r.lossless and r.n_pieces > 1000 for r in out)
