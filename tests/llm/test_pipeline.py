import corpus_pipeline

from claimlake.llm import line_dedup, toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_versions(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        seen[name] = (before, docs)
        if name != "piece sampling":
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone and len(gone & toxic) >= 0.5 * len(gone)
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: brute.noisy_or(r.text, toxicity.bags, model) for r in before.collect()}
    assert all((scores[i] >= 0.5) == (i in gone) for i in scores if abs(scores[i] - 0.5) > 1e-4)
    before, after = seen["near dedup"]
    want = {r[0] for r in brute.near_dedup([(r.doc_id, r.text) for r in before.collect()], 5, 80) if r[3]}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = seen["mixing"]
    _, copies = brute.mixing([(r.doc_id, r.text, r.source) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _, n in copies for _ in range(n))
    before, after = seen["piece sampling"]
    assert after.count() == before.count() and after.filter("not lossless").count() == 0


def lines_of(out, key="doc_id"):
    return {r[key]: r.text.split("\n") for r in out.collect()}


def test_line_stage_drops_planted_lines_and_no_others(spark):
    rows = [(i, f"own {i}\n" + ("planted\n" if i % 10 == 0 else "") + ("rare\n" if i < 6 else "") + f"end {i}", "en", "ab"[i % 2]) for i in range(400)]
    rows += [(1000 + i, f"own {i}\n" + ("few" if i < 4 else f"end {i}"), "en", "small") for i in range(10)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r[0]: [x for x in r[1].split("\n") if x != "planted"] for r in rows}
    assert lines_of(corpus_pipeline.drop_lines(spark, docs, SF)) == want


def test_line_digest_drops_planted_lines_and_no_others(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<p>own {i}</p>" + ("<p>planted</p>" if i % 5 < 2 else "") + f"<p>end {i}</p>") for i in range(60)]
    out = lines_of(line_dedup.digest(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all([x for x in out[i] if x] == [f"own {i}", f"end {i}"] for i in range(60))


def test_line_stage_keeps_the_text_of_copies(spark):
    clean = "a clean text\nof three\n\nlines"
    rows = [(i, clean if i % 3 == 0 else f"own {i}\nplanted\nend {i}", "en", "abc"[i % 2]) for i in range(120)] + [(500 + i, clean, "en", "c") for i in range(6)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = lines_of(corpus_pipeline.drop_lines(spark, docs, SF))
    assert out == {r[0]: [x for x in r[1].split("\n") if x != "planted"] for r in rows}


def test_stages_take_odd_rows(spark):
    text = "some plain words of a clean text that goes on for a while"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, text, None, None, 57), (4, text, "en", "b", 57), (4, text, "en", "b", 57), (None, text + " x", "en", "b", 59), (5, "one", "en", "c", 3), (6, "q" * 100_000, "en", "c", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity_of_row double, lines_seen int, host string, mix_copies string, id string"
    docs = spark.createDataFrame([(*r, 9.0, 7, "h", "m", "i") for r in rows], schema)
    for start in (docs, docs.limit(0)):
        found = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, found, SF)
            if name == "piece sampling":
                assert out.filter("not lossless").count() == 0 and out.count() == found.count()
                continue
            assert out.columns == docs.columns
            found = spark.createDataFrame(out.collect(), schema)
            assert found.filter("toxicity_of_row <> 9.0 or lines_seen <> 7 or mix_copies <> 'm' or id <> 'i'").count() == 0
            if name != "mixing" and start is docs:
                ids = sorted(r.doc_id or 0 for r in found.collect())
                assert ids == ([0, 1, 2, 3, 5, 6] if name == "near dedup" else [0, 1, 2, 3, 4, 4, 5, 6])
