import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators import duplicates, metrics, recognition, relational
from claimlake.operators.components import connected_components


def test_components_of_a_long_path_and_an_empty_table(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert connected_components(df.limit(0)).count() == 0


def test_languages_and_claims(spark):
    df = spark.createDataFrame([("naan oru job venum",), ("வேலை ready for you",), ("mera paisa",), (None,)], "t string")
    rows = df.select(T.language_tokens("t").alias("k"), T.script_counts("t").alias("s")).select(T.code_mix(F.col("k"), F.col("s")).alias("m"), T.transliteration(F.col("k"), F.col("s")).alias("l")).collect()
    assert [r.m.mixed for r in rows] == [True, True, False, False]
    assert [r.l and r.l.language for r in rows] == ["ta", None, "hi", None]
    claims = spark.createDataFrame([("Is ABC approved?",), ("Invest 500 and receive 900",), ("ABC has 5,000 customers",), ("ABC was founded in 1999",), ("click here",)], "t string")
    assert [r[0] for r in claims.select(T.claim_type("t")).collect()] == ["QUESTION", "FINANCIAL", "NUMERICAL", "FACTUAL", "INSTRUCTION"]


def test_greedy_split_passes_over_large_and_synthetic_clusters(spark):
    rows = [("a", 10, True), ("b", 5, False), ("c", 3, False), ("d", 2, False), ("e", 80, False)]
    df = spark.createDataFrame(rows, "cluster string, size long, synthetic boolean")
    got = {r.cluster: r.split for r in relational.greedy_split(df).collect()}
    assert got["e"] == "test" and got["a"] == "validation" and got["b"] == "validation" and got["c"] == "train"


def test_metrics_known_answers(spark):
    df = spark.createDataFrame([("q1", 1, True), ("q1", 2, False), ("q2", 1, False), ("q2", 2, True), ("q3", 1, False)], "q string, k int, hit boolean")
    r = metrics.ranking(df, "q", "k", "hit").first()
    assert r.queries == 3 and abs(r.mrr - 0.5) < 1e-12 and abs(r.recall_1 - 1 / 3) < 1e-12 and abs(r.recall_5 - 2 / 3) < 1e-12
    assert metrics.error_rate(spark.createDataFrame([("abc", "abd"), ("", "x")], "r string, h string"), "r", "h").first().cer == 2 / 3


@pytest.mark.parametrize("shape", ["star", "chain", "stars", "mixed"])
def test_components_of_hot_parents(spark, monkeypatch, shape):
    """With a bound of a few rows, centres of stars are looked up by broadcasts; the classes are those of a plain search."""
    monkeypatch.setattr(relational, "heavy", functools.partial(_heavy_at, relational.heavy))
    rnd = random.Random(1)
    edges = {"star": [(1, i) for i in range(2, 60)], "chain": [(i, i + 1) for i in range(60)], "stars": [(c * 100, c * 100 + i) for c in range(5) for i in range(1, 20)] + [(c * 100 + 3, c * 100 + 103) for c in range(4)], "mixed": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(5, None), (7, 7)]}[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def _heavy_at(heavy, counts, n, least):
    return heavy(counts, n, 3)


def test_image_classes_of_common_pictures(spark):
    rows = [(i, 5) for i in range(40)] + [(100 + i, 5 ^ (1 << i)) for i in range(6)] + [(200, 5 ^ 0b111111), (300, -1), (301, -1), (400, None)]
    got = {r.ordinal: (r["class"], r.links) for r in duplicates.image_classes(spark.createDataFrame(rows, "ordinal long, image_hash long"), 5).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 5
    known = [(o, h) for o, h in rows if h is not None]
    for o, h in known:
        links = sum(near(h, g) for p, g in known if p != o)
        assert got[o] == (300 if h == -1 else 0, links)
    assert duplicates.image_pairs(spark.createDataFrame(rows, "ordinal long, image_hash long")).filter("a = 0").count() == 6


def test_similar_images_tell_all_pairs_of_rows(spark, tmp_path):
    from claimlake.plans import catalog

    known = {i: int.from_bytes(hashlib.sha256(b"img%d" % (i % 60)).digest()[:8]) ^ (1 << i % 64) for i in range(1, 2001)}
    spark.range(1, 2001).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = [(r.a, r.b, r.distance, r.similarity) for r in catalog.QUERIES["d4_j9_g15_similar_images"](spark, str(tmp_path)).collect()]
    first = {i: i for i in known} | {b: a for a, b, d, _ in found if d == 0}
    edges = {(a, b): d for a, b, d, _ in found if d}
    assert len(found) == len({x[:2] for x in found}) and all(s == 1 - d / 64 for *_, d, s in found)
    for i in known:
        for j in range(1, i):
            d = (known[i] ^ known[j]).bit_count()
            p, q = sorted((first[i], first[j]))
            assert (0 if p == q else edges.get((p, q))) == (d if d <= 5 else None)


def test_a_graph_reads_evidence_once_for_nodes_and_once_for_edges(spark):
    from claimlake.operators import graph

    text = lambda names, **more: spark.createDataFrame([], ", ".join([f"{n} string" for n in names.split()] + [f"{n} {t}" for n, t in more.items()]))
    posts = text("post_id text language platform username image image_hash phash split campaign translation source_group family", verified="boolean")
    claims, evidence = text("claim_id post_id claim_text claim_type language", check_worthiness="double"), text("evidence_id claim_id evidence_text relation source_type source_url")
    for found in graph.build(posts, claims, evidence, text("comment_id post_id text language")):
        assert found._jdf.queryExecution().analyzed().collectLeaves().size() == 8  # of posts 4 times, claims 2, evidence 1, comments 1


def exchanged_by(df):
    """The keys of each exchange by keys of a plan, as it is before it adapts."""
    import re

    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_labels_exchange_lines_by_post_only_and_build_only_evidence(spark):
    from claimlake.plans import catalog

    keys = exchanged_by(catalog.QUERIES["g18_j2_j3_labels"](spark, "/root/testdata/sf0.001"))
    assert keys and not any("node_id" in k or "claim_id" in k or "graph_id" in k for k in keys)


def test_a_manifest_exchanges_only_comments_by_node_and_nothing_by_claim(spark):
    from claimlake.plans import catalog

    keys = exchanged_by(catalog.QUERIES["a12_g21_manifest"](spark, "/root/testdata/sf0.001"))
    assert keys and not any("claim_id" in k or "graph_id" in k for k in keys) and sum("node_id" in k for k in keys) == 2


@pytest.mark.parametrize("of_claims", [False, True])
def test_graphs_keep_one_of_each_node_and_edge(spark, of_claims):
    from claimlake.operators import graph

    post = "post_id string, text string, language string, platform string, username string, verified boolean, image string, image_hash string, phash string, split string, campaign string, translation string, source_group string, family string"
    posts = spark.createDataFrame([("p1", "a", "en", "x", "u", True, "i", None, None, "train", None, None, None, None), ("p2", "b", "en", "x", None, None, None, None, None, "test", "k", None, None, None)], post)
    claims = spark.createDataFrame([("c1", "p1", "t", "JOB", "en", 0.5), ("c2", "p2", "t", "JOB", "en", 0.5), ("c3", "p9", "t", "JOB", "en", 0.5)], "claim_id string, post_id string, claim_text string, claim_type string, language string, check_worthiness double")
    found = [("e1", "c1", "p1", "s", "SUPPORTS", "WEB", "https://a.b"), ("e2", "c1", "p1", "s", "NEUTRAL", "WEB", "https://a.b"), ("e3", "c2", "p2", "s", "X", "WEB", " "), ("e4", "c3", "p9", "s", "X", "WEB", None)]
    evidence = spark.createDataFrame(found + found[:2], "evidence_id string, claim_id string, post_id string, evidence_text string, relation string, source_type string, source_url string")
    comments = spark.createDataFrame([("m1", "p1", "t", "en"), ("m1", "p1", "t", "en")], "comment_id string, post_id string, text string, language string")
    nodes, edges = graph.build(posts, claims, evidence, comments, of_claims)
    kinds = lambda df, c: sorted((r["graph_id"], r[c]) for r in df.collect())
    assert kinds(nodes, "node_type") == [*(("graph_p1", k) for k in ("ACCOUNT", "CLAIM", "COMMENT", "EVIDENCE", "EVIDENCE", "IMAGE", "POST", "URL")), *(("graph_p2", k) for k in ("CLAIM", "EVIDENCE", "POST"))]
    assert kinds(edges, "edge_type") == [*(("graph_p1", k) for k in ("ASSOCIATED_WITH", "CONTAINS", "HAS_CLAIM", "HAS_COMMENT", "NEUTRAL_TO", "SOURCED_FROM", "SOURCED_FROM", "SUPPORTS")), *(("graph_p2", k) for k in ("HAS_CLAIM", "NEUTRAL_TO"))]
    for dealt in (lambda df: df, lambda df: df.drop("post_id")):  # a manifest's input need not come from ``build``
        one = graph.manifest(dealt(nodes), dealt(edges)).head()
        assert (one.graphs, one.nodes, one.clusters, one.post_nodes, one.url_nodes, one.edges, one.sourced_from_edges) == (2, 11, 2, 2, 1, 10, 2)
    none = graph.manifest(nodes.limit(0), edges.limit(0)).head()
    assert (none.graphs, none.nodes, none.clusters, none.claim_nodes, none.edges, none.density) == (0, 0, 0, 0, 0, 0.0)


def small_parts(spark, comments=3):
    """Parts of two graphs, one of which has comments."""
    from claimlake.operators import graph

    post = "post_id string, text string, language string, platform string, username string, verified boolean, image string, image_hash string, phash string, split string, campaign string, translation string, source_group string, family string"
    posts = spark.createDataFrame([("p1", "a", "en", "x", "u", True, "i", None, None, "train", None, None, None, None), ("p2", "b", "en", "x", None, None, None, None, None, "test", "k", None, None, None)], post)
    claims = spark.createDataFrame([("c1", "p1", "t", "JOB", "en", 0.5), ("c2", "p2", "t", "JOB", "en", 0.5), ("c3", "p1", "t", "JOB", "en", 0.5)], "claim_id string, post_id string, claim_text string, claim_type string, language string, check_worthiness double")
    found = [("e1", "c1", "p1", "s", "SUPPORTS", "WEB", "https://a.b"), ("e2", "c1", "p1", "s", "NEUTRAL", "WEB", "https://a.b"), ("e3", "c2", "p2", "s", "X", "WEB", " ")]
    evidence = spark.createDataFrame(found, "evidence_id string, claim_id string, post_id string, evidence_text string, relation string, source_type string, source_url string")
    said = spark.createDataFrame([(f"m{i}", "p1", "t", "en") for i in range(comments)], "comment_id string, post_id string, text string, language string")
    return graph.parts(posts, claims, evidence, said, of_claims=True)


@pytest.mark.parametrize("most", [4, 10_000])
def test_graphs_of_posts_are_written_where_they_lie_and_hot_comments_apart(spark, tmp_path, most):
    from claimlake.operators import graph
    from claimlake.sources import files

    nodes, edges = small_parts(spark, 30)
    path = f"file://{tmp_path}/graphs"
    files.write_graphs_of_posts(nodes, edges, path, most)
    back = files.read_whole_graphs(spark, path, *(graph.whole(x).drop("post_id") for x in (nodes, edges)))
    for got, want in zip(back, (nodes, edges)):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, graph.whole(want).drop("post_id").collect()), key=str)
    written = spark.read.json(path)
    assert written.filter("graph_id = 'graph_p1'").count() == 1 if most > 100 else written.agg(F.max(F.greatest(F.size("nodes"), F.size("edges")))).head()[0] < 60
    assert all(f.name.endswith(".gz") for f in tmp_path.rglob("part-*"))  # texts repeat from graph to graph, so they are written compressed


def test_an_edge_index_meets_its_nodes_where_they_lie(spark):
    from claimlake.operators import graph

    nodes, edges = small_parts(spark)
    want = graph.edge_index(graph.whole(nodes), graph.whole(edges))
    assert sorted(map(tuple, graph.edge_index_by_post(nodes, edges).collect())) == sorted(map(tuple, want.collect()))
    keys = exchanged_by(graph.edge_index_by_post(*without_comments(nodes, edges)))
    assert keys and not any("node_id" in k or "graph_id" in k for k in keys)


def without_comments(*parts):
    return [{k: df.limit(0) if k == "comment" else df for k, df in of.items()} for of in parts]


def test_an_audit_meets_edges_with_nodes_where_they_lie(spark, monkeypatch):
    from claimlake.operators import graph

    nodes, edges = small_parts(spark)
    bad = dict(edges)
    bad["claim"] = edges["claim"].filter("target_node_id <> 'node_claim_c3'")
    bad["evidence"] = edges["evidence"].unionByName(edges["evidence"].filter("edge_type = 'SUPPORTS'")).withColumn("relation", F.when(F.col("relation") == "NEUTRAL", "X").otherwise(F.col("relation")))
    bad["comment"] = edges["comment"].withColumn("target_node_id", F.when(F.col("target_node_id").endswith("1"), "none").otherwise(F.col("target_node_id")))
    got, want = graph.audit_by_post(nodes, bad).collect(), graph.audit(graph.whole(nodes), graph.whole(bad))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) == [("graph_p1", 1, 2, 1)]
    monkeypatch.setattr(graph, "_faults", lambda nodes, edges: want.limit(0))  # for comments
    keys = exchanged_by(graph.audit_by_post(*without_comments(nodes, bad)))
    assert keys and not any("node_id" in k or "graph_id" in k for k in keys)


def test_a_feature_matrix_exchanges_no_texts_and_lines_only_by_post(spark):
    from claimlake.plans import catalog

    df = catalog.QUERIES["x1_x11_feature_matrix"](spark, "/root/testdata/sf0.001")
    keys = exchanged_by(df)
    assert keys and not any("claim_id" in k or "graph_id" in k for k in keys) and sum("node_id" in k for k in keys) == 2  # comments
    assert len({k for k in keys if "l_orderkey" not in k and "o_orderkey" not in k}) <= 8


def test_features_of_claims_meet_evidence_by_post(spark):
    from claimlake.operators import features

    claims = spark.createDataFrame([("p1", "c1", 1), ("p1", "c2", 2), ("p2", "c3", 1), ("p3", None, 1), ("p4", "c4", None)], "post_id string, claim_id string, claim_no int")
    evidence = spark.createDataFrame([("p1", "c2", "WEB", "https://a.b/1"), ("p1", "c2", "", "https://a.b/2"), ("p2", "c3", None, None), ("p3", None, "X", "y"), ("p4", "c4", "Z", "https://c.d"), ("p5", "c5", "Z", None)], "post_id string, claim_id string, source_type string, source_url string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(features.evidence_features(claims, evidence, of_claims=True)) == rows(features.evidence_features(claims, evidence))
    items = evidence.filter("claim_id is not null").groupBy("post_id", "claim_id").agg(F.count("*").alias("n"))
    assert rows(features.first_items(claims.filter("claim_no is not null"), items, "claim_no")) == rows(features.first_items(claims.filter("claim_no is not null"), items.drop("post_id"), "claim_no")) == [("p1", "c2", 2), ("p2", "c3", 1)]


def test_graph_features_by_post_count_comments(spark):
    from claimlake.operators import features, graph

    nodes, edges = small_parts(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(features.graph_features_by_post(nodes, edges)) == rows(features.graph_features(graph.whole(nodes), graph.whole(edges)))
    assert rows(features.edge_features_by_post(edges)) == rows(features.edge_features(graph.whole(edges)))


def test_matrix_queries_keep_only_what_they_read(spark, monkeypatch):
    from claimlake.plans import catalog, feature_queries

    kept = []
    monkeypatch.setattr(feature_queries, "cut", lambda df: kept.append(df.columns) or df)
    for name, most in (("x12_training_matrix", 6), ("a15_value_counts", 4), ("a18_p24_completeness", 0), ("a16_high_correlations", 0)):
        kept.clear()
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sum(map(len, kept)) <= most
    kept.clear()
    catalog.QUERIES["x13_a10_p25_u5_matrix_checks"](spark, "/root/testdata/sf0.001")
    assert len(kept) == 1  # the whole matrix, once


def test_first_splits_join_only_the_groups_they_need(spark):
    from claimlake.plans import model_queries
    from claimlake.plans.feature_queries import matrix

    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    part, whole = matrix(t, model_queries.SPLIT_ON), matrix(t)
    reads = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    assert reads(part) < reads(whole)
    assert sorted(part.collect()) == sorted(whole.select(part.columns).collect())


def test_near_pairs_by_parts_and_blocks_match_brute_force(spark):
    import random

    draw = random.Random(5)
    texts = ["", "a", "ab", "A", "\U0001d11eab", "ab\U0001d11e"]
    for _ in range(12):  # families of near texts of one alphabet, most of whose grams all texts share
        base = [draw.choice("abcd ") for _ in range(draw.choice((30, 200, 600)))]
        for _ in range(8):
            at = draw.randrange(len(base))
            texts.append("".join([*base[:at], draw.choice("efgh"), *base[at + 1 :]]))

    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()

    sets = {i * 7 % 1009: grams(t) for i, t in enumerate(texts)}
    expected = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i * 7 % 1009, t, i % 3 > 0) for i, t in enumerate(texts)], "ordinal long, text string, fresh boolean")
    for known in (df.drop("fresh"), df):
        kept = {i * 7 % 1009 for i in range(len(texts)) if i % 3 > 0 or "fresh" not in known.columns}
        got = {(r.a, r.b): r.score for r in duplicates.near_pairs(known, part_rows=20, block_grams=400).collect()}
        assert len(got) > 100 and got == {k: v for k, v in expected.items() if kept & set(k)}
    assert duplicates.near_pairs(df.filter("text = ''")).count() == 0


def test_parities_pass_over_unlike_sets_and_over_no_like_ones():
    import numpy as np

    draw = np.random.default_rng(3)
    common, sets = draw.integers(0, 1 << 62, 900), []
    for _ in range(30):  # families of two that share half of their grams with all others
        own = np.unique(np.concatenate([draw.choice(common, 450, replace=False), draw.integers(0, 1 << 62, 450)]))
        sets += [own, np.unique(np.concatenate([own[draw.integers(0, 40) :], draw.integers(0, 1 << 62, draw.integers(0, 40))]))]
    sizes, bits = np.array([len(x) for x in sets]), 512
    x = duplicates._parities(sizes, np.concatenate(sets), 2 * bits)
    assert (duplicates._folded(x, bits) == duplicates._parities(sizes, np.concatenate(sets), bits)).all()
    could = duplicates._could_meet(x, sizes, duplicates._folded(x, bits), sizes, 0.85)
    like = np.array([[len(np.intersect1d(a, b)) >= 0.85 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert like.sum() > 100 and (could | ~like).all() and could.sum() < 150


def test_shingles_by_pieces_and_shares_read_once(spark):
    texts = ["", " ", "a", "aB", "abc", "Abcab cabca", "\U0001d11ea\U0001d11eb \U0001d11ea\U0001d11eb", "a\nb\n\nc d", "தமிழ் job", "Ünï 12", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.char_shingles("t").alias("g"))
    for r in got.collect():
        t = " ".join((r.t or "").lower().split())
        assert (set(r.g), len(r.g)) == ((s := {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()), len(s))
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no lambda for each character
    both = df.select(recognition.language_label("t").alias("a"), recognition.share("t", recognition.LATIN).alias("b"), F.inline(recognition.labelled_shares("t")))
    assert both.filter(~(F.col("a").eqNullSafe(recognition.script_label(F.col("ta"), F.col("la"))) & (F.col("b") == F.col("la")))).count() == 0 and both.count() == len(texts)


def test_only_texts_that_composition_can_change_go_to_python(spark):
    import unicodedata

    from claimlake.functions import unicode as U

    texts = ["", None, "plain", "caf\u00e9", "cafe\u0301", "\u1100\u1161\u11a8", "\u212b", "\u0958", "a\u0316\u0301", "\u0ba8\u0bbf x", "\u02ff"] * 20
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select("t", U.nfc("t").alias("n"))
    assert [r.n for r in got.collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert "RLIKE" in got._jdf.queryExecution().optimizedPlan().toString()
