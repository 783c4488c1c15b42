import json

import pytest
from pyspark.sql import functions as F

from claimlake.sources import files, numbered


@pytest.mark.parametrize("each", [1, 3, 7, 64, 1 << 20])
def test_lines_are_numbered_like_a_plain_reader_does(spark, tmp_path, each):
    """Ranges shorter than lines, CRLF, blank lines, a last line that is not ended, an empty file, a hidden one."""
    contents = {"a.txt": b"one\r\ntwo\n\n\nfive \xc3\xa9\r\nlast", "b.txt": b"\n\nx\n", "c.txt": b"", "d.txt": b"only\n", "_hidden": b"no\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = []
    for name, data in contents.items():
        lines = data.split(b"\n")
        want += [(name, i + 1, x.removesuffix(b"\r").decode()) for i, x in enumerate(lines) if name[0] != "_" and (i < len(lines) - 1 or x)]
    got = numbered.read_numbered(spark, [str(tmp_path)], each).withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_errors_tell_their_lines_and_columns_are_mapped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"n": 1, "t": "a"}\n\n{bad\n[1]\n{"n": 2}\n"text"\n')
    rows = numbered.parsed(numbered.read_numbered(spark, [str(tmp_path / "x.jsonl")], 8), "id long, title string", {"id": "n", "title": "t"})
    got = {r.line: (r.record, r.error) for r in rows.collect()}
    assert {k: tuple(v[0]) for k, v in got.items() if v[1] is None} == {1: (1, "a"), 5: (2, None)}
    assert {k for k, v in got.items() if v[1]} == {3, 4, 6} and got[3][1].startswith("not a JSON object: line 3 of ") and got[3][1].endswith("x.jsonl")


def test_entities_come_from_the_root_or_from_the_splits(spark, tmp_path):
    line = lambda **v: json.dumps(v) + "\n"
    for split, ids in (("train", "ab"), ("test", "bc")):
        (tmp_path / split).mkdir()
        (tmp_path / split / "claims.jsonl").write_text("".join(line(claim_id=i, n=split) for i in ids) + "{broken\n")
    (tmp_path / "posts.jsonl").write_text(line(post_id="p") + line(post_id="p"))
    folder = f"file://{tmp_path}"
    assert files.entity_paths(spark, folder, "posts") == [f"{folder}/posts.jsonl"] and files.entity_paths(spark, folder, "none") == []
    paths = files.entity_paths(spark, folder, "claims")
    good, bad = files.read_entities(spark, paths, "claim_id string, n string", "claim_id")
    assert sorted(map(tuple, good.collect())) == [("a", "train"), ("b", "test"), ("c", "test")]  # by file, then line: test comes first
    assert [(r.line, r.value) for r in bad.collect()] == [(3, "{broken")] * 2
    good, bad = files.read_entities(spark, files.entity_paths(spark, folder, "posts"), "post_id string", "post_id")
    assert good.count() == 1 and bad.count() == 0
    good, bad = files.read_entities(spark, [], "post_id string", "post_id")
    assert good.count() == bad.count() == 0


def test_kinds_of_records(spark):
    rows = [{"risk_level": 1, "claim_text": "x"}, {"evidence_text": "e", "post_id": 1}, {"claim_text": "c"}, {"query_text": "q"}, {"post_id": "p"}, {"other": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "payload string")
    assert [r.k for r in df.select(files.kind_of().alias("k")).collect()] == ["risk", "evidence", "claim", "query", "post", None]


def test_whole_graphs_come_back_and_hot_ones_in_parts(spark, tmp_path):
    nodes = spark.createDataFrame([(f"g{i % 3}", f"n{i}", ["train", "test"][i % 3 == 2], None, i * 0.5, i % 2 == 0) for i in range(50)], "graph_id string, node_id string, split string, cluster_id string, score double, verified boolean")
    edges = spark.createDataFrame([("g0", f"e{i}", "train", None, f"n{3 * i}") for i in range(9)], "graph_id string, edge_id string, split string, cluster_id string, target string")
    for most, files_of in ((10_000, 3), (5, None)):
        path = f"file://{tmp_path}/graphs{most}"
        files.write_whole_graphs(nodes, edges, path, most)
        n, e = files.read_whole_graphs(spark, path, nodes, edges)
        assert sorted(map(tuple, n.collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str)
        assert sorted(map(tuple, e.collect()), key=str) == sorted(map(tuple, edges.collect()), key=str)
        written = spark.read.json(path)
        assert (written.count() == 3) == (files_of == 3) and written.filter("split = 'test'").select("graph_id").distinct().count() == 1
