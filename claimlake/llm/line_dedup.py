"""Boilerplate lines by their frequency within a site, with DataFrame functions only.

For each host, a line's ratio is the number of its pages that hold the line over all its pages.  Lines above
``ratio`` on at least ``least_pages`` pages are dropped.  Lines are compared without blanks at their ends,
other white space of a line counting as blanks, by 64 bits of hashes inside their host; blank lines are never counted and stay.

A host has at most (mean distinct lines per page) / ``ratio`` such lines, so its list is
small whatever its number of pages.  The lists of all hosts are broadcast when they take under ``MOST_BROADCAST``
bytes; else the pages of a host are dealt to a task for every ``HOST_PAGES`` of them, each with the host's list.
Hot hosts and lines are summed before the exchange, and the totals of hot hosts reach their lines by a broadcast.

Null texts stay null, null hosts are one host, an empty table gives an empty result.  Repeated rows count as pages, or with
``once`` texts with the same lines count as one page of their host, so copies alone make no line boilerplate.
Columns of the input keep their names and values, but for the text; one that is called ``lines_seen`` or ``lines_dropped``
gives way to the operator's own, unless ``counts`` is false and none are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, heavy, unused

SCRIPTS = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|td|th|h[1-6]|br|hr|title|head|body|html|blockquote|pre)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
MOST_BROADCAST = 64 << 20  # bytes of all hosts' lists
HOST_PAGES = 10_000  # of a host, over which its pages and lines are dealt to several tasks


def page_text(html: str) -> Column:
    """Text of a page, a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SCRIPTS, ""), BLOCKS, "\n"), TAGS, "")


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _plain(text: Column) -> Column:
    """``text`` with blanks for other white space inside its lines, in one pass over the page."""
    return F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")


def _names(text: Column) -> Column:
    """Names of a text's lines in order; null for blank ones."""
    return F.transform(F.split(_plain(text), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, least_pages: int, once: bool, host_pages: int = HOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """``host, names``: the boilerplate of each host that has any; and ``host, copies`` of the hosts with over ``host_pages``.

    Their totals reach the lines by a broadcast, so the lines of a hot host are never in one task.
    """
    pages = pages.select(F.coalesce(host, F.lit("\0")).alias("host"), F.array_compact(F.array_distinct(_names(text))).alias("names"))
    if once:
        pages = pages.distinct()
    totals = cut(pages.groupBy("host").agg(F.count("*").alias("total")))
    many = cut(heavy(totals, "total", host_pages))
    lines = pages.select("host", F.explode_outer("names").alias("name")).filter("name is not null")  # a plain explode would have the names worked out once more in a filter
    counts = cut(lines.groupBy("host", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages))
    counts = counts.join(F.broadcast(many.select("host", F.col("total").alias("hot"))), "host", "left")
    of = lambda rows, total: rows.filter(F.col("n") > ratio * F.col(total)).select("host", "name")
    frequent = of(counts.filter("hot is not null"), "hot").unionByName(of(counts.filter("hot is null").join(totals, "host"), "total"))
    return frequent.groupBy("host").agg(F.collect_set("name").alias("names")), many.select("host", "copies")


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = 0.3, least_pages: int = 3, once: bool = False, counts: bool = True, host_pages: int = HOST_PAGES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text_col``, and ``lines_seen``, ``lines_dropped`` if ``counts``."""
    lists, many = boilerplate(pages, F.col(f"`{host_col}`"), F.col(f"`{text_col}`"), ratio, least_pages, once, host_pages)
    lists = cut(lists)
    host, salt, names, stays, copies = unused(pages, "host", "salt", "names", "stays", "copies")
    many = F.broadcast(many.withColumnsRenamed({"host": host, "copies": copies}))
    lists = lists.withColumnsRenamed({"host": host, "names": names})
    rows, on = pages.withColumn(host, F.coalesce(F.col(f"`{host_col}`"), F.lit("\0"))), [host]
    size = lists.agg(F.sum(8 * F.size(names) + F.octet_length(host) + 64)).first()[0] or 0
    if size <= most_broadcast:
        lists = F.broadcast(lists)
    else:  # the pages of a host with many are dealt to as many tasks as hold them, its list goes to each
        each = F.coalesce(F.col(copies), F.lit(1).cast("long"))
        lists, on = lists.join(many, host, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), each - 1))).drop(copies), [host, salt]
        rows = rows.join(many, host, "left").withColumn(salt, F.pmod(F.xxhash64(f"`{text_col}`"), each)).drop(copies)
    rows = rows.join(lists, on, "left")
    text, known = F.col(f"`{text_col}`"), F.col(names)
    pairs = F.arrays_zip(F.split(text, "\n").alias("line"), _names(text).alias("name"))
    rows = rows.withColumn(stays, F.when(known.isNotNull(), F.filter(pairs, lambda x: x["name"].isNull() | ~F.array_contains(known, x["name"]))))
    kept = F.when(known.isNull(), text).otherwise(F.array_join(F.transform(stays, lambda x: x["line"]), "\n"))
    n = F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0))
    columns = [kept.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in pages.columns if not (counts and c.lower() in ("lines_seen", "lines_dropped"))]
    if counts:
        columns += [n.alias("lines_seen"), F.when(known.isNull(), 0).otherwise(n - F.coalesce(F.size(stays), F.lit(0))).alias("lines_dropped")]
    return rows.select(*columns)


def digest(pages: DataFrame) -> DataFrame:
    """Pages without the boilerplate of their hosts."""
    rows = pages.select("page_id", host("url").alias("host"), page_text("html").alias("text"))
    return drop_boilerplate(rows, "host", "text").withColumns({c: F.col(c).cast("long") for c in ("lines_seen", "lines_dropped")})


SQL = r"""
WITH texts AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|td|th|h[1-6]|br|hr|title|head|body|html|blockquote|pre)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS text, row_number() OVER () AS r
  FROM pages),
lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
bare AS (SELECT *, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')) AS name FROM lines),
totals AS (SELECT host, count(*) AS total FROM texts GROUP BY host),
counts AS (SELECT host, name, count(DISTINCT r) AS n FROM bare WHERE name <> '' GROUP BY host, name),
frequent AS (SELECT c.host, c.name FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE c.n >= 3 AND c.n > 0.3 * t.total),
marked AS (SELECT b.*, f.name IS NOT NULL AS gone FROM bare b LEFT JOIN frequent f ON b.host IS NOT DISTINCT FROM f.host AND b.name = f.name),
joined AS (
  SELECT r, count(*) AS lines_seen, count(*) FILTER (gone) AS lines_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT t.page_id, t.host, j.text, coalesce(j.lines_seen, 0) AS lines_seen, coalesce(j.lines_dropped, 0) AS lines_dropped FROM texts t LEFT JOIN joined j USING (r)
"""
