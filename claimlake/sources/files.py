"""Readers and writers of posts and related records."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys under which a JSON object may hold its list of records, first found wins.
WRAPPERS = ("posts", "records", "data", "items")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` (JSON text) of each record: an array, an object that wraps a list, or one object."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    wrapped = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "array<variant>") for k in WRAPPERS))
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(wrapped)
    return raw.select(F.explode(F.coalesce(listed, F.array("v"))).alias("v")).select(F.to_json("v").alias("payload"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` and ``error`` of each line that is not blank; lines that are no JSON stay, marked."""
    lines = spark.read.text(path).select(F.trim("value").alias("payload"), F.col("_metadata.file_path").alias("file")).filter("payload <> ''")
    return lines.withColumn("error", F.when(F.try_parse_json("payload").isNull(), F.lit("not JSON")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` of each row, all values strings."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("payload"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` of each paragraph; blank lines part them."""
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n\n")).alias("t"))
    return texts.select(F.trim(F.regexp_replace("t", r"^\s+|\s+$", "")).alias("text")).filter("text <> ''").select(F.to_json(F.struct("text")).alias("payload"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv, ".txt": read_paragraphs, ".text": read_paragraphs}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder by its suffix; other suffixes are an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file type: {suffix or path}")
    return READERS[suffix](spark, path)


def _first(*paths: str) -> Column:
    """The first of these JSON fields that is a non-empty string."""
    return F.coalesce(*(F.nullif(F.get_json_object("payload", p), F.lit("")) for p in paths))


#: Platforms known.
PLATFORMS = "reddit youtube x instagram facebook linkedin tiktok telegram whatsapp generic text screenshot unknown".split()


def _list(*paths: str) -> Column:
    """The first of these JSON fields that is a list, as strings; else an empty one."""
    none = F.array().cast("array<string>")
    lists = (F.when(F.get_json_object("payload", p).startswith("["), F.from_json(F.get_json_object("payload", p), "array<string>")) for p in paths)
    return F.coalesce(*lists, none)


def normalise_posts(records: DataFrame) -> DataFrame:
    """The canonical post of each record; an id that is missing comes from the payload's hash.

    ``not_lists`` names the fields that should be lists and are something else; ``metadata`` is the record's own, as JSON.
    """
    platform = F.lower(F.trim(F.coalesce(_first("$.platform"), F.lit("unknown"))))
    raw = F.coalesce(_first("$.original_text", "$.text", "$.content.text", "$.body", "$.title"), F.lit(""))
    text = F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " "))
    path = _first("$.image_path")
    images = _list("$.images", "$.media.images")
    is_a = lambda p, c: F.coalesce(F.get_json_object("payload", p).startswith(c), F.lit(False))
    images = F.when(~is_a("$.images", "[") & ~is_a("$.media", "{") & path.isNotNull(), F.array(path)).otherwise(images)
    listed = [("images", "$.images"), ("hashtags", "$.hashtags"), ("mentions", "$.mentions"), ("urls", "$.urls"), ("comments", "$.comments")]
    return records.select(
        F.coalesce(_first("$.post_id", "$.id"), F.concat(F.lit("post_"), F.substring(F.sha2("payload", 256), 1, 12))).alias("post_id"),
        F.when(platform.isin(PLATFORMS), platform).otherwise(_first("$.platform")).alias("platform"),
        F.when((F.size(images) > 0) & (text == ""), "image").when(F.size(images) > 0, "image_text").otherwise("text").alias("post_type"),
        _first("$.source_url", "$.url").alias("source_url"),
        _first("$.author.username", "$.author.display_name", "$.author").alias("author"),
        text.alias("text"),
        raw.alias("original_text"),
        _first("$.title", "$.content.title").alias("title"),
        _list("$.hashtags").alias("hashtags"),
        _list("$.mentions").alias("mentions"),
        _list("$.urls").alias("urls"),
        images.alias("images"),
        _first("$.timestamp", "$.created_at").alias("timestamp"),
        F.coalesce(_first("$.language", "$.lang"), F.lit("en")).alias("language"),
        F.coalesce(F.get_json_object("payload", "$.is_example").cast("boolean"), F.lit(False)).alias("is_example"),
        _first("$.metadata").alias("metadata"),
        F.array_compact(F.array(*(F.when(~F.get_json_object("payload", p).startswith("["), F.lit(n)) for n, p in listed))).alias("not_lists"),
    )


_COMMENT = "struct<id:string,parent_id:string,author:string,body:string,score:double,created_utc:double>"


def first_comments(records: DataFrame, limit: int = 10) -> DataFrame:
    """``post_id, place, comment_id, parent_id, author, text, score``: of each record's first ``limit`` comments, those with a body, in order."""
    listed = F.slice(F.coalesce(F.from_json(F.get_json_object("payload", "$.comments"), f"array<{_COMMENT}>"), F.array().cast(f"array<{_COMMENT}>")), 1, limit)
    rows = records.select(_first("$.post_id", "$.id").alias("post_id"), F.posexplode(listed).alias("place", "c"))
    return rows.filter(F.coalesce(F.col("c.body"), F.lit("")) != "").select("post_id", "place", F.col("c.id").alias("comment_id"), "c.parent_id", "c.author", F.col("c.body").alias("text"), "c.score")


def validation_errors() -> Column:
    """What keeps a post out, as an array of texts."""
    from ..functions.text import is_reddit_post

    checks = [
        (F.coalesce(F.col("post_id"), F.lit("")) == "", "Missing post_id."),
        (~F.coalesce(F.col("platform").isin(PLATFORMS), F.lit(False)), "Unknown platform."),
        (F.col("timestamp").isNotNull() & F.try_to_timestamp("timestamp").isNull(), "Invalid timestamp."),
        (F.col("source_url").isNotNull() & ~is_reddit_post("source_url"), "Invalid Reddit post URL."),
    ]
    found = F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)), lambda x: x.isNotNull())
    return F.concat(found, F.transform("not_lists", lambda f: F.concat(F.initcap(f), F.lit(" must be a list."))))


def route(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted posts, and rejected ones with their errors."""
    checked = posts.withColumn("errors", validation_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines, in a folder for each split if one is named."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(split) if split else writer).json(path)


def entity_paths(spark: SparkSession, folder: str, name: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> list[str]:
    """The file of an entity at the root of a dataset, or where there is none those in the folders of its splits."""
    at = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = lambda path: at(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(path))
    root = f"{folder}/{name}.jsonl"
    return [root] if exists(root) else [path for split in splits if exists(path := f"{folder}/{split}/{name}.jsonl")]


def read_entities(spark: SparkSession, paths: list[str], schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSONL files, the first of each key by file and line, and the lines that could not be read: ``file, line, value``."""
    from ..operators.relational import keep_first
    from .numbered import parsed, read_numbered

    if not paths:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, line long, value string")
    rows = parsed(read_numbered(spark, paths), schema)
    names = spark.createDataFrame([], schema).columns
    good = keep_first(rows.filter("error is null").select("record.*", "file", "line"), [key], [F.col("file"), F.col("line")])
    return good.select(*names), rows.filter("error is not null").select("file", "line", "value")


#: The key that tells a record's kind, first match wins.
KINDS = [("risk", "risk_level"), ("evidence", "evidence_text"), ("claim", "claim_text"), ("query", "query_text"), ("post", "post_id")]


def kind_of(payload: str = "payload") -> Column:
    """The kind of a JSON record by its keys; null for none."""
    out = F.when(F.lit(False), "")
    for kind, key in KINDS:
        out = out.when(F.get_json_object(payload, f"$.{key}").isNotNull(), kind)
    return out


def permitted_sources(registry: DataFrame) -> DataFrame:
    """Approved sources, and whether their licence is valid."""
    return registry.filter("status = 'APPROVED'").withColumn("licence_valid", ~F.upper(F.coalesce("license", F.lit("UNSPECIFIED"))).isin("UNSPECIFIED", "UNKNOWN", "PENDING_REVIEW"))


def text_records(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``payload`` of texts given directly, white space collapsed; an empty one is an error."""
    bare = [" ".join(t.split()) for t in texts]
    if not all(bare):
        raise ValueError("empty text")
    return spark.createDataFrame([(t,) for t in bare], "text string").select(F.to_json(F.struct("text")).alias("payload"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in a folder for each split; a node or edge that a split has from several graphs is written once."""
    from ..operators.relational import keep_first

    for name, df, key in (("nodes", nodes, "node_id"), ("edges", edges, "edge_id")):
        once = keep_first(df, ["split", key], [F.col("graph_id")])
        once.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("split").json(f"{path}/{name}")


_FRAME = ["graph_id", "split", "cluster_id"]


def _members(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """A row for each node and each edge, with its fields in order and a hash of its id."""
    node, edge = (F.struct(c, *(x for x in df.columns if x not in (*_FRAME, *more, c))) for df, c in ((nodes, "node_id"), (edges, "edge_id")))
    return nodes.select(*more, *_FRAME, F.xxhash64("node_id").alias("h"), node.alias("node")).unionByName(edges.select(*more, *_FRAME, F.xxhash64("edge_id").alias("h"), edge.alias("edge")), allowMissingColumns=True)


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, *_FRAME, "part").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(F.collect_list("edge")).alias("edges")).drop(*keys)


def _write_graphs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").partitionBy("split").json(path)


def write_whole_graphs(nodes: DataFrame, edges: DataFrame, path: str, most: int = 10_000) -> None:
    """Each graph as one JSON object with its nodes and edges, all fields in order, in a folder of compressed lines for each split.

    A graph of over ``most`` nodes and edges (a post with a hot number of comments) is written in parts, so no group is without bound.
    """
    from ..operators.relational import heavy

    rows = _members(nodes, edges)
    many = heavy(rows.groupBy("graph_id").agg(F.count("*").alias("n")), "n", most).drop("n")
    rows = rows.join(F.broadcast(many), "graph_id", "left").withColumn("part", F.pmod("h", F.coalesce("copies", F.lit(1).cast("long"))))
    _write_graphs(_listed(rows), path)


def write_graphs_of_posts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """As ``write_whole_graphs``, of ``graph.parts``: rows are listed where they lie, and only comments are exchanged.

    Comments of posts with over ``most`` of them are dealt to several tasks, as parts of their own.
    """
    from ..operators.graph import whole
    from ..operators.relational import heavy

    said = _members(nodes["comment"], edges["comment"], "post_id")
    many = heavy(said.groupBy("post_id").agg(F.count("*").alias("n")), "n", most).drop("n")
    said = said.join(F.broadcast(many), "post_id", "left")
    rows = _members(whole(nodes, "comment"), whole(edges, "comment"), "post_id").unionByName(said.filter("copies is null").drop("copies").repartition("post_id"))
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("h")) - 1
    few = rows.withColumn("part", F.floor(place / most).cast("long"))
    hot = said.filter("copies is not null").withColumn("part", -1 - F.pmod("h", "copies")).drop("copies")
    _write_graphs(_listed(few, "post_id").unionByName(_listed(hot, "post_id")), path)


def read_whole_graphs(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs that ``write_whole_graphs`` wrote, with the columns of the given frames."""
    frame = _FRAME
    kinds = lambda df: ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema if f.name not in frame)
    rows = spark.read.schema(f"graph_id string, cluster_id string, part long, nodes array<struct<{kinds(nodes)}>>, edges array<struct<{kinds(edges)}>>, split string").json(path)
    back = lambda name, df: rows.select(*frame, F.explode(name).alias("x")).select(*frame, "x.*").select(*df.columns)
    return back("nodes", nodes), back("edges", edges)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The feature matrix as CSV with a header and as JSON lines in a folder for each split, and its schema as JSON."""
    matrix.write.mode("overwrite").option("header", True).partitionBy("split").csv(f"{path}/csv")
    matrix.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("split").json(f"{path}/jsonl")
    matrix.sparkSession.createDataFrame([(matrix.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def write_manifest(summary: DataFrame, path: str, version: str) -> None:
    """A one-row summary with its version and time as one JSON line."""
    summary.withColumns({"dataset_version": F.lit(version), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}).coalesce(1).write.mode("overwrite").json(path)


def write_predictions(rows: DataFrame, path: str, version: str) -> None:
    """``id, truth, predicted, scores`` as JSON lines under the model's version; another run of a version replaces its own rows, no others'.

    One row for each id: of rows that share one, the first by prediction.
    """
    from ..operators.relational import keep_first

    once = keep_first(rows, ["id"], [F.col("predicted"), F.to_json("scores")])
    out = once.select(F.col("id").cast("string").alias("id"), F.col("truth").alias("true_label"), F.col("predicted").alias("predicted_label"), F.col("scores").alias("probabilities"), F.lit(version).alias("model_version"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("model_version").json(path)


def read_predictions(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """``id, true_label, predicted_label, probabilities, model_version`` of one version, or of all."""
    rows = spark.read.schema("id string, true_label string, predicted_label string, probabilities map<string,double>, model_version string").json(path)
    return rows if version is None else rows.filter(F.col("model_version") == version)
