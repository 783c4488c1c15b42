"""Queries of readers and canonical posts, over records that are derived from the given tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files, numbered
from .lineage import shared_path, spread, until_the_end
from .registry import query

#: A JSON record for each order: fields that are absent, of another type, nested, or given under another name.
K = "o_orderkey"
PAYLOAD = " || ".join(
    [
        f"'{{\"' || CASE WHEN {K} % 3 = 0 THEN 'id' ELSE 'post_id' END || '\": \"p' || CAST({K} AS STRING) || '\"'",
        f"""CASE {K} % 4 WHEN 0 THEN ', "platform": " Reddit "' WHEN 1 THEN ', "platform": "X"' WHEN 2 THEN ', "platform": "mars"' ELSE '' END""",
        f"""CASE {K} % 5 WHEN 0 THEN ', "images": ["a.png", "b.png"]' WHEN 1 THEN ', "images": "a.png"' WHEN 2 THEN ', "media": {{"images": ["m.png"]}}' WHEN 3 THEN ', "image_path": "q.png"' ELSE '' END""",
        f"""CASE {K} % 6 WHEN 0 THEN ', "original_text": "  "' WHEN 1 THEN ', "text": "Hello   world "' WHEN 2 THEN ', "content": {{"text": "inner  text", "title": "Inner"}}' WHEN 3 THEN ', "body": "the body"' WHEN 4 THEN ', "title": "Only title"' ELSE '' END""",
        f"""CASE {K} % 7 WHEN 0 THEN ', "hashtags": ["x", "y"]' WHEN 1 THEN ', "hashtags": "x"' WHEN 2 THEN ', "mentions": ["m"], "urls": []' ELSE '' END""",
        f"""CASE {K} % 8 WHEN 0 THEN ', "author": {{"username": "u1", "display_name": "D"}}' WHEN 1 THEN ', "author": "plain"' WHEN 2 THEN ', "author": {{"display_name": "D"}}' ELSE '' END""",
        f"""CASE {K} % 9 WHEN 0 THEN ', "timestamp": "2024-01-02T03:04:05"' WHEN 1 THEN ', "timestamp": "yesterday"' ELSE '' END""",
        f"""CASE {K} % 11 WHEN 0 THEN ', "source_url": "https://www.reddit.com/r/a/comments/b1/"' WHEN 1 THEN ', "url": "https://x.com/a"' ELSE '' END""",
        f"""CASE WHEN {K} % 13 = 0 THEN ', "is_example": true, "language": "ta"' ELSE '' END || '}}'""",
    ]
)


def records(t):  # noqa: ANN001, ANN201
    return spread(t("orders").select(K)).selectExpr(f"{PAYLOAD} AS payload")


_TEXT = f"""CASE {K} % 6 WHEN 1 THEN 'Hello world' WHEN 2 THEN 'inner text' WHEN 3 THEN 'the body' WHEN 4 THEN 'Only title' ELSE '' END"""
_IMAGES = f"CASE {K} % 5 WHEN 0 THEN 'a.png,b.png' WHEN 2 THEN 'm.png' WHEN 3 THEN 'q.png' ELSE '' END"


@query(f"""SELECT 'p' || {K} AS post_id, ['reddit', 'x', 'mars', 'unknown'][{K} % 4 + 1] AS platform, {_TEXT} AS text, {_IMAGES} AS images,
 CASE WHEN {_IMAGES} = '' THEN 'text' WHEN {_TEXT} = '' THEN 'image' ELSE 'image_text' END AS post_type, CASE {K} % 6 WHEN 2 THEN 'Inner' WHEN 4 THEN 'Only title' END AS title,
 CASE WHEN {K} % 7 = 0 THEN 'x,y' ELSE '' END AS hashtags, CASE WHEN {K} % 7 = 2 THEN 'm' ELSE '' END AS mentions, CASE {K} % 8 WHEN 0 THEN 'u1' WHEN 1 THEN 'plain' WHEN 2 THEN 'D' END AS author,
 CASE WHEN {K} % 13 = 0 THEN 'ta' ELSE 'en' END AS language, {K} % 13 = 0 AS is_example FROM orders""")
def p2_canonical_posts(t):
    posts = files.normalise_posts(records(t))
    return posts.select("post_id", "platform", "text", F.array_join("images", ",").alias("images"), "post_type", "title", F.array_join("hashtags", ",").alias("hashtags"), F.array_join("mentions", ",").alias("mentions"), "author", "language", "is_example")


@query(f"""SELECT 'p' || {K} AS post_id, array_to_string(list_filter([CASE WHEN {K} % 4 = 2 THEN 'Unknown platform.' END, CASE WHEN {K} % 9 = 1 THEN 'Invalid timestamp.' END, CASE WHEN {K} % 11 = 1 THEN 'Invalid Reddit post URL.' END,
 CASE WHEN {K} % 5 = 1 THEN 'Images must be a list.' END, CASE WHEN {K} % 7 = 1 THEN 'Hashtags must be a list.' END], lambda x: x IS NOT NULL), ' ') AS errors FROM orders
 WHERE {K} % 4 = 2 OR {K} % 9 = 1 OR {K} % 11 = 1 OR {K} % 5 = 1 OR {K} % 7 = 1""")
def p12_rejected_posts(t):
    return files.route(files.normalise_posts(records(t)))[1].select("post_id", F.array_join("errors", " ").alias("errors"))


@query(f"""SELECT 'p' || {K} AS post_id, place::INTEGER AS place, ['a', 'b', 'c'][place + 1] AS comment_id, CASE WHEN place = 2 THEN 'a' END AS parent_id, CASE place WHEN 0 THEN 'says ' || {K} ELSE 'reply' END AS text, CASE WHEN place = 2 THEN 2.5::DOUBLE END AS score
 FROM orders, (SELECT unnest([0, 2]) AS place) WHERE {K} % 6 = 0""")
def o9_first_comments(t):
    """Of four comments the first three, of which one is empty."""
    comments = f"""'[{{"id": "a", "body": "says ' || CAST({K} AS STRING) || '"}}, {{"id": "b", "body": ""}}, {{"id": "c", "parent_id": "a", "body": "reply", "score": 2.5}}, {{"id": "d", "body": "late"}}]'"""
    rows = t("orders").selectExpr(f"""'{{"id": "p' || CAST({K} AS STRING) || '"' || CASE WHEN {K} % 6 = 0 THEN ', "comments": ' || {comments} WHEN {K} % 6 = 1 THEN ', "comments": "none"' ELSE '' END || '}}' AS payload""")
    return files.first_comments(rows, 3).drop("author")


@query(r"""SELECT doc_id, text AS raw_text, trim(regexp_replace(regexp_replace(regexp_replace(translate(translate(translate(regexp_replace(nfc_normalize(text), '[^\P{C}\n\r\t]', '', 'g'), '“”', '""'), '‘’', ''''''), '—–', '--'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean_text FROM documents""")
def p7_p3_recognised_text(t):
    """The whole chain with Unicode composition, the text as it was beside it."""
    return spread(t("documents").select("doc_id", "text")).select("doc_id", T.recognised("text").alias("x")).select("doc_id", F.col("x.raw").alias("raw_text"), F.col("x.text").alias("clean_text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[^\P{Cc}\t\n]|\p{Cf}', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS clean FROM documents")
def p8_minimal_clean(t):
    return spread(t("documents").select("doc_id", "text")).select("doc_id", T.minimal_clean("text").alias("clean"))


@query("SELECT conv_id, turn, 0::BIGINT AS errors FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT -1, -1, count(*) FROM conversations WHERE conv_id % 7 = 0")
def s8_s9_numbered_records(t):
    """Turns written as JSON lines under other names, every seventh conversation broken, read in ranges of 4 KB; and how many lines have an error that names them."""
    rows = t("conversations").selectExpr("CASE WHEN conv_id % 7 = 0 THEN '{\"c\": ' ELSE to_json(named_struct('c', conv_id, 'n', turn)) END AS value")
    path = shared_path(rows.sparkSession, "lines")
    until_the_end(rows.sparkSession, path)
    rows.write.text(path)
    read = numbered.parsed(numbered.read_numbered(rows.sparkSession, [path], 4096), "conv_id long, turn long", {"conv_id": "c", "turn": "n"})
    good = read.filter("error is null").select("record.conv_id", "record.turn", F.lit(0).cast("long").alias("errors"))
    named = F.col("error").contains(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of ")))
    return good.unionByName(read.agg(F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.count_if(named).alias("errors")))


LINKS = ["'https://www.Reddit.com/r/a/comments/b1/title?x=1'", "'https://youtu.be/v'", "'http://instagram.com/p'", "'https://m.facebook.com:8080/p'", "'https://twitter.com/a'", "'https://www.linkedin.com/in/x'", "'https://TikTok.com/@a'", "'mailto:x@y.z'", "''", "CAST(NULL AS STRING)", "'https:///nohost'", "'ftp://reddit.com/r/a/comments/b1'", "'https://reddit.com/r/a/'", "'HTTPS://Shop.example.org/a?b#c'"]
_N = len(LINKS)
LINK = f"CASE {K} % {_N} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(LINKS)) + " END"


@query(f"""SELECT {K} AS id, ['reddit', 'youtube', 'instagram', 'facebook', 'x', 'linkedin', 'tiktok', 'unknown', 'unknown', NULL, 'unknown', 'reddit', 'reddit', 'unknown'][{K} % {_N} + 1] AS platform,
 {K} % {_N} = 0 AS reddit_post, [NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'URL must use HTTP/HTTPS.', 'Invalid URL.', 'Invalid URL.', 'URL must contain a valid domain.', 'URL must use HTTP/HTTPS.', NULL, NULL][{K} % {_N} + 1] AS error,
 ['www.reddit.com', 'youtu.be', 'instagram.com', 'm.facebook.com:8080', 'twitter.com', 'www.linkedin.com', 'tiktok.com', 'unknown_domain', 'unknown_domain', 'unknown_domain', 'unknown_domain', 'reddit.com', 'reddit.com', 'shop.example.org'][{K} % {_N} + 1] AS host FROM orders""")
def s13_p13_p14_g8_links(t):
    """Links of every platform and of none, with every fault."""
    rows = t("orders").selectExpr(f"{K} AS id", f"{LINK} AS url")
    return rows.select("id", F.when(F.col("url").isNotNull(), T.platform("url")).alias("platform"), T.is_reddit_post("url").alias("reddit_post"), T.url_error("url").alias("error"), T.url_host("url").alias("host"))
