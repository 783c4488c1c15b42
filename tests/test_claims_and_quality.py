from pyspark.sql import functions as F

from claimlake.operators import claims, features, quality, recognition


def test_claims_atoms_and_queries(spark):
    posts = spark.createDataFrame([("p1", "ABC was founded in 1999. It has 5,000 customers and it is not approved by the government! ABC was founded in 1999."), ("p2", ""), ("p3", None)], "post_id string, text string")
    typed = claims.typed(claims.extract(posts, "post_id", "text")).cache()
    assert [(r.claim_text, r.span_start, r.span_end) for r in typed.orderBy("claim_ix").collect()] == [("ABC was founded in 1999.", 0, 24), ("It has 5,000 customers and it is not approved by the government!", 25, 89)]
    atoms = claims.atoms(typed).orderBy("claim_ix", "part_ix").collect()
    assert [(a.predicate, a.subject, a.polarity) for a in atoms] == [("founded", "ABC", "POSITIVE"), ("has", "ABC", "POSITIVE"), ("government_approved", "ABC", "NEGATIVE")]
    assert (atoms[0].value, atoms[0].unit, atoms[1].value, atoms[1].unit) == ("1999", "year", "5000", "customers")
    got = {(q.query_text, q.query_type, q.priority) for q in claims.search_queries(claims.atoms(typed)).collect()}
    assert got == {("ABC founded 1999", "TEMPORAL_VERIFICATION", "HIGH"), ("ABC government approval registration", "REGISTRATION_VERIFICATION", "HIGH")}
    counts = {r.post_id: (r.extracted_count, r.atomic_count, r.queries_count, r.warnings) for r in claims.pipeline(posts, "post_id", "text").collect()}
    assert counts["p1"] == (2, 3, 2, []) and counts["p2"][3] == counts["p3"][3] == ["No claims extracted from post."]


def test_subjects_are_put_in_and_promises_fall_in_two(spark):
    rows = [("a", "Fine Bank was founded in 2018, has 50,000 customers, is government approved, and guarantees 20% monthly returns."), ("b", "If you invest ₹10,000 today, you will receive ₹20,000 within 7 days."), ("c", "It has 9 customers. Due to fees, costs rise, and fall.")]
    found = claims.atoms(claims.typed(claims.extract(spark.createDataFrame(rows, "post_id string, text string"), "post_id", "text"))).orderBy("post_id", "claim_ix", "part_ix").collect()
    a = [(r.atom_text, r.subject, r.predicate, r.value) for r in found if r.post_id == "a"]
    assert a == [("Fine Bank was founded in 2018", "Fine Bank", "founded", "2018"), ("Fine Bank has 50,000 customers", "Fine Bank", "has", "50000"), ("Fine Bank is government approved", "Fine Bank", "government_approved", None), ("Fine Bank guarantees 20% monthly returns.", "Fine Bank", "guarantees", "20")]
    assert [(r.predicate, r.value, r.currency, r.time_kind, r.time_value) for r in found if r.post_id == "b"] == [("invests", "10000", "INR", "date", "today"), ("receives", "20000", "INR", "deadline", "within 7 days")]
    assert [(r.claim_text, r.subject) for r in found if r.post_id == "c"] == [("It has 9 customers.", "It"), ("Due to fees, costs rise, and fall.", "It"), ("Due to fees, costs rise, and fall.", "It")]


def test_relation_features_and_matrix(spark):
    evidence = spark.createDataFrame([("p", "SUPPORTS", "a"), ("p", "CONTRADICTS", "a"), ("p", "SUPPORTS", "b"), ("p", "NEUTRAL", "c")], "post_id string, relation string, source string")
    posts = spark.createDataFrame([("p",), ("q",)], "post_id string")
    rows = {r.post_id: r for r in features.matrix(posts, [features.relation_features(evidence)]).collect()}
    assert rows["p"].supports_ratio == 0.5 and rows["p"].evidence_relation_entropy == 1.5 and rows["q"].evidence_count == 0
    assert features.leaking_columns(["a", "risk_label", "x_target"]) == ["risk_label", "x_target"]


def test_quality_control(spark):
    posts = spark.createDataFrame([("p",)], "post_id string")
    rows = spark.createDataFrame([("c1", "t", "p", "JOB", 0.5), ("c2", " ", "p", "JOB", 0.5), ("c3", "t", "x", "ODD", 2.0)], "claim_id string, claim_text string, post_id string, claim_type string, check_worthiness double")
    got = {r.claim_id: r.reasons for r in quality.check_claims(rows, posts).collect()}
    assert got == {"c1": [], "c2": ["MISSING_CANONICAL_TEXT"], "c3": ["BROKEN_REFERENCES", "INVALID_LABELS"]}
    assert all("BROKEN_REFERENCES" not in r.reasons for r in quality.check_claims(rows, posts.limit(0)).collect())


def test_recognition(spark):
    df = spark.createDataFrame([(1, 1, "hello world", 0.9, "en", 3), (1, 2, "வணக்கம்", 0.95, "ta", 5), (1, 3, "", 0.99, "en", 0), (2, 1, "x", 0.1, "en", 1)], "image int, k int, text string, conf double, mode string, n int")
    best = {r.image: r.k for r in recognition.best_candidate(df, "image", "text", "conf", "mode", "n", "k").collect()}
    assert best == {1: 2, 2: 1}
    assert [r[0] for r in df.orderBy("image", "k").select(recognition.language_label("text")).collect()] == ["en", "ta", "unknown", "en"]
    assert [r[0] for r in df.orderBy("image", "k").select(recognition.status("text", F.lit(0.5))).collect()] == ["SUCCESS", "SUCCESS", "OCR_FAILED", "PARTIAL"]
    errors = recognition.character_errors(spark.createDataFrame([(1, "aதcகx", "xஅcdxக")], "i int, r string, h string"), "i", "r", "h").orderBy("at").collect()
    assert [(e["at"], e.expected, e.found, e.error) for e in errors] == [(1, "த", "அ", "tamil_substitution"), (3, "க", "d", "tamil_to_latin_confusion"), (5, None, "க", "insertion")]


def test_table_function_gives_the_rows_of_extract(spark):
    import random

    from pyspark.sql.functions import udtf

    rnd = random.Random(3)
    bits = ["ABC Co was founded in 2018", "has 5 users", "is fine.", "and guarantees 3% returns", ", and ", " and ", "\n", "Is it?", "is it? ", " If you pay, and has more. ", "x y ", "  ", "has 5 users", "மாதம் 20% லாபம். ", "Ünï was here! "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))) for i in range(400)] + [(900, None), (901, ""), (902, " \n ")]
    df = spark.createDataFrame(rows, "post_id long, text string")
    spark.udtf.register("segment_claims", udtf(claims.SegmentClaims, returnType=claims.SegmentClaims.RETURNS))
    df.createOrReplaceTempView("some_posts")
    names = ["post_id", "claim_ix", "claim_text", "normalized", "span_start", "span_end"]
    got = spark.sql("SELECT post_id, s.* FROM some_posts, LATERAL segment_claims(text) s").select(names).collect()
    want = claims.extract(df, "post_id", "text").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 500


def test_segmentation_takes_time_in_proportion(spark):
    """Twice the sentences, at most about twice the time; the fastest of a few runs of each."""
    import time

    text = lambda n: " ".join(f"The company number {i} was founded in {1900 + i % 100}, has {i} users." for i in range(n))
    segment = claims.SegmentClaims()

    def fastest(n):
        runs = []
        for _ in range(5):
            began = time.process_time()
            assert len(list(segment.eval(text(n)))) == 2 * n
            runs.append(time.process_time() - began)
        return min(runs)

    assert fastest(8000) < 3 * fastest(4000)
    long = spark.createDataFrame([(1, text(3000))], "post_id long, text string")
    assert claims.extract(long, "post_id", "text").count() == 6000


def test_words_end_at_other_letters_as_in_sql(spark, tmp_path):
    import duckdb

    from claimlake.plans import catalog

    from .duck import assert_same

    texts = ["Nuñez. Noñasció en sóar", "noñ", "sureño é5 x", "peopleñ 7", "hasé", "The Shop was here and isñ open", "no", "not", "é5", "ifé a, b", "", None]
    spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, x or "") for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("k3_k4_k10_claims", "k2_quantities", "k1_k2_k5_document_claims"):
        assert_same(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLES[name], con)


def test_rules_are_tried_once_for_each_text(spark):
    rows = [(f"p{i}", text) for i, text in enumerate(["Acme was founded in 1999, has 3 shops", "", None, "It pays $5. It pays $5."] * 5)]
    posts = spark.createDataFrame([*rows, ("q0", "It pays $5. It pays $5.")], "post_id string, text string")
    worked = []

    def work(texts):
        worked.append(texts.count())
        return claims.atoms(claims.typed(claims.extract(texts, "post_id", "text")))

    plain = lambda df: sorted(map(str, df.collect()))
    got = claims.by_text(posts, "post_id", "text", work)
    assert worked == [4] and plain(got) == plain(claims.atoms(claims.typed(claims.extract(posts, "post_id", "text"))))


def test_claims_without_spans_are_those_with_them_and_words_are_sought_before_their_edges(spark):
    """A text of many clauses, whose spans were sought one after the other; words at edges, inside others and in capitals."""
    text = " ".join(f"Acme has {i} shops, is number {i}!" for i in range(300)) + " GIVE it. Forgiven. I THINK so. 100% sure. Users pay 5%. அனுப்பு"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    with_spans, without = claims.extract(df, "id", "text"), claims.extract(df, "id", "text", spans=False)
    assert "span_start" not in without.columns and sorted(without.collect()) == sorted(with_spans.select(*without.columns).collect())
    from claimlake.functions import text as T

    rows = claims.typed(without).select("*", *(F.col("claim_text").rlike(T.edged(p)).alias(name) for name, p, _ in T.CLAIM_TESTS)).collect()
    assert {r.claim_type for r in rows} >= {"REQUEST", "OPINION", "FACTUAL"}
    for r in rows:
        first = next((name for name, _, _ in T.CLAIM_TESTS if r[name]), None)
        assert first in (None, r.claim_type)
