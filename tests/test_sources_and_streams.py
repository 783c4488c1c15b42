import functools
import json

import pytest
from pyspark.sql import functions as F

from claimlake.functions.unicode import nfc, word_distance, word_edit_distance
from claimlake.operators import duplicates, quality
from claimlake.sources import files
from claimlake.streaming import streams


def test_readers(spark, tmp_path):
    post = {"id": "1", "text": "a  b", "platform": "Reddit"}
    (tmp_path / "a.json").write_text(json.dumps([post, {"text": "c"}]))
    (tmp_path / "b.json").write_text(json.dumps({"records": [post]}))
    (tmp_path / "c.json").write_text(json.dumps(post))
    (tmp_path / "d.jsonl").write_text(json.dumps(post) + "\n\n{bad\n")
    (tmp_path / "e.csv").write_text('id,text\n1,"a, ""b"""\n')
    (tmp_path / "f.txt").write_text("one\nline\n\n\n  two \n")
    count = {p: files.read_records(spark, str(tmp_path / p)).count() for p in ("a.json", "b.json", "c.json", "d.jsonl", "e.csv", "f.txt")}
    assert count == {"a.json": 2, "b.json": 1, "c.json": 1, "d.jsonl": 2, "e.csv": 1, "f.txt": 2}
    posts = files.normalise_posts(files.read_records(spark, str(tmp_path / "a.json"))).collect()
    assert {(p.text, p.platform) for p in posts} == {("a b", "reddit"), ("c", "unknown")} and all(p.post_id for p in posts)
    assert files.read_records(spark, str(tmp_path / "d.jsonl")).filter("error is not null").count() == 1
    with pytest.raises(ValueError):
        files.read_records(spark, "x.pdf")


def test_route(spark):
    rows = [json.dumps(x) for x in ({"id": "1", "platform": "reddit", "source_url": "https://www.reddit.com/r/a/comments/b1/"}, {"id": "2", "platform": "mars"}, {"id": "3", "platform": "x", "url": "https://x.com/a"})]
    good, bad = files.route(files.normalise_posts(spark.createDataFrame([(r,) for r in rows], "payload string")))
    assert [r.post_id for r in good.collect()] == ["1"]
    assert {r.post_id: r.errors for r in bad.collect()} == {"2": ["Unknown platform."], "3": ["Invalid Reddit post URL."]}


def test_unicode_functions(spark):
    df = spark.createDataFrame([("é", ["a", "b"], ["a", "c", "d"]), (None, None, ["x"])], "t string, a array<string>, b array<string>")
    rows = df.select(nfc("t").alias("t"), word_edit_distance("a", "b").alias("d")).collect()
    assert [(r.t, r.d) for r in rows] == [("é", 2), (None, None)]
    assert word_distance([], ["a"]) == 1 and word_distance(["a", "b", "c"], ["b", "c"]) == 1


def sequential(rows, threshold=0.85):
    @functools.cache
    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()

    canonical, out = [], {}
    for o, t, h in rows:
        key = " ".join(t.lower().split())
        hit = next(((c, "EXACT") for c, ct, _ in canonical if " ".join(ct.lower().split()) == key), None)
        hit = hit or next(((c, "TEXT") for c, ct, _ in canonical if grams(t) and grams(ct) and len(grams(t) & grams(ct)) >= threshold * len(grams(t) | grams(ct))), None)
        hit = hit or next(((c, "IMAGE") for c, _, ch in canonical if h is not None and ch is not None and bin((h ^ ch) & (2**64 - 1)).count("1") <= 5), None)
        out[o] = hit or (None, None)
        if not hit:
            canonical.append((o, t, h))
    return out


def test_canonicalise_matches_one_by_one(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    texts = [base, base + "!", base + "!!", base.upper(), "other words entirely", base[:-8], base[3:], "x", "", "other words entirely."]
    rows = [(i, t, (1 << i) * 77 if i % 2 else None) for i, t in enumerate(texts)] + [(20, "new a b c d", 77 * 2), (21, "nothing alike here", 77 * 2 + 1)]
    df = spark.createDataFrame(rows, "ordinal long, text string, image_hash long")
    got = {r.ordinal: (r.duplicate_of, r.kind) for r in duplicates.canonicalise(df).collect()}
    assert got == sequential(rows)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps({"id": str(i), "platform": "text" if i else "mars", "text": f"t{i % 2}"}) for i in range(4)))
    streams.collect_into(streams.new_posts(spark, str(source)), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 1

    events = spark.createDataFrame([(i % 3, f"x{i % 2}", i * 600) for i in range(30)], "user int, text string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    streams.into_table(streams.windowed_counts(stream(), "ts", "user", "1 hour", delay="0 seconds"), "hourly", str(tmp_path / "c2"), "update").awaitTermination()
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "user").count()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] >= 30 and spark.table("hourly").select("start", "user").distinct().count() == want.count()
    streams.into_table(streams.first_seen(stream(), "text", "ts"), "firsts", str(tmp_path / "c3")).awaitTermination()
    assert spark.table("firsts").count() == 2


def test_annotation_states_in_batch_and_stream(spark, tmp_path):
    kinds = ["accept", "assign", "assign", "submit", "accept", "assign", "flag", "assign"]
    rows = [(f"t{k}", i, kinds[(i + k) % 8]) for k in range(4) for i in range(8)] + [("u", 0, "assign")]
    events = spark.createDataFrame(rows, "task string, s long, kind string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {tuple(r) for r in quality.task_states(events, "task", "ts", "kind").collect()}
    assert ("u", "IN_PROGRESS", 0, 0) in want
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    streams.into_table(streams.annotation_states(stream, "task"), "states", str(tmp_path / "c"), "update").awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == want


def test_merge_canonical_by_batches(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    first = spark.createDataFrame([(1, base, None), (2, base + "!", None), (3, "other words entirely", None)], "ordinal long, text string, image_hash long")
    second = spark.createDataFrame([(4, base + "!!", None), (5, "something new that is long enough", None)], "ordinal long, text string, image_hash long")
    third = spark.createDataFrame([(0, base + "!!!", None), (-5, "something new that is long enough.", None), (9, "the last of all the texts here", None)], "ordinal long, text string, image_hash long")
    for k, part in enumerate((first, second, third)):  # the third has smaller ordinals than the near copies that are known
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        streams.merge_canonical(stream, str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.ordinal for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 3, 5, 9]


def test_late_rows_are_counted():
    assert streams.late_rows([{"stateOperators": [{"numRowsDroppedByWatermark": 2}]}, {"stateOperators": []}]) == 2


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("g1", "n1", "train"), ("g2", "n1", "train"), ("g2", "n2", "test")], "graph_id string, node_id string, split string")
    edges = spark.createDataFrame([("g1", "e1", "train")], "graph_id string, edge_id string, split string")
    files.write_graphs(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 2 and spark.read.json(str(tmp_path / "g/edges/split=train")).count() == 1
    matrix = spark.createDataFrame([("p", 1.5, True, "train")], "post_id string, x double, y boolean, split string")
    files.write_matrix(matrix, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/csv")).first().x == "1.5" and "boolean" in spark.read.text(str(tmp_path / "m/schema")).first()[0]
    files.write_manifest(matrix.select("x"), str(tmp_path / "k"), "v1")
    assert spark.read.json(str(tmp_path / "k")).first().dataset_version == "v1"
    assert files.text_records(spark, [" a  b "]).first().payload == '{"text":"a b"}'
    with pytest.raises(ValueError):
        files.text_records(spark, [" "])
