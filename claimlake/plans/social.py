"""Posts, claims, evidence and the like, derived from the given tables by expressions that Spark and DuckDB read alike.

Orders with their customers become posts, order lines the claims of a post and their evidence, customers and parts the
claims and evidence of the retrieval set.  Texts are put together so that all rules of the library meet cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import spread

Tables = Callable[[str], DataFrame]


def _case(of: str, values: list[str]) -> str:
    """Text number ``of`` modulo their count."""
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


NAME = "(c_mktsegment || ' Wealth')"
N = "CAST(o_orderkey % 97 + 3 AS STRING)"
YEAR = "CAST(1990 + o_custkey % 30 AS STRING)"
TEXTS = [
    f"{NAME} || ' was founded in ' || {YEAR} || ', has ' || {N} || ',000 customers, is government approved, and guarantees ' || {N} || '% monthly returns. Apply now!'",
    f"'If you invest ₹' || {N} || '000 today, you will receive ₹' || {N} || '500 within ' || {N} || ' days.'",
    f"{NAME} || ' headquarters are in Nation' || {N} || '. It guarantees 12.5% yearly returns and has 900 customers. They are not government approved.'",
    f"'According to ' || {NAME} || ', profits rise and losses fall.' || chr(10) || 'Is it real? Is it  real?' || chr(10) || chr(10) || 'is it real?'",
    f"'आज ₹' || {N} || '00 निवेश करने पर 7 दिनों के भीतर ₹9000'",
    f"{NAME} || ' हर महीने ' || {N} || '% रिटर्न की गारंटी देता है'",
    f"'I think ' || {NAME} || ' is fine, but maybe not. DM me today'",
    "''",
    f"'The shop sold shoes for $' || {N} || ' and the bags for rs. 2,500. It owns 3 stores and they operate since 2018'",
    f"'Limited offer: pay $' || {N} || ' registration fee, and send the money by June 2024! ' || {NAME} || ' has ' || {N} || ' customers while others wait'",
    f"{NAME} || ' is approved by the government and ' || {NAME} || ' was founded in ' || {YEAR} || '. Does it pay? The company has 1,200 customers'",
    "'Results came in ' || chr(10) || '   ' || chr(10) || 'no numbers here. Stated by the Times, rates fell'",
    f"'invest ₹10000 today and receive ₹10000 after 5 days, not ₹20,000'",
    f"'Users: ' || {N} || ' people joined. Click here. 40% of ' || {N} || ' employees left'",
]
POSTS = {
    "ordinal": "o_orderkey",
    "post_id": "'p' || CAST(o_orderkey AS STRING)",
    "text": _case("o_orderkey", TEXTS),
    "platform": _case("o_orderkey", ["'reddit'", "'X'", "'telegram'", "'mastodon'", "'facebook'", "'unknown'", "'youtube'"]),
    "language": _case("o_orderkey", ["'en'", "'ta'", "'hi'", "'TA-en'", "'hi-en'", "'fr'"]),
    "script": _case("o_orderkey", ["'Latin'", "'Tamil'", "'Devanagari'"]),
    "username": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE lower(c_name) END",
    "verified": "o_custkey % 5 = 0",
    "campaign": "CASE WHEN o_orderkey % 11 = 0 THEN 'c' || CAST(o_custkey % 50 AS STRING) END",
    "translation": "CASE WHEN o_orderkey % 13 = 0 THEN 't' || CAST(o_custkey % 60 AS STRING) END",
    "source_group": "CASE WHEN o_orderkey % 2 = 0 THEN 's' || CAST(o_custkey % 400 AS STRING) END",
    "family": "CASE WHEN o_orderkey % 17 = 0 THEN 'f' || CAST(o_custkey % 30 AS STRING) END",
    "image": "CASE WHEN o_orderkey % 3 = 0 THEN 'img' || CAST(o_custkey % 300 AS STRING) END",
    "ocr_text": "CASE WHEN o_orderkey % 6 = 0 THEN 'Seen on ' || c_name WHEN o_orderkey % 9 = 0 THEN '' END",
    "ocr_confidence": "CASE WHEN o_orderkey % 12 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END",
    "phash": "CASE WHEN o_orderkey % 15 = 0 THEN 'ph' || CAST(o_custkey AS STRING) END",
    "image_reuse": "o_orderkey % 21 = 0",
    "url": _case("o_orderkey", ["CAST(NULL AS STRING)", "'https://bit.ly/' || CAST(o_orderkey AS STRING)", "'https://Shop.example.com:80/x'", "'https://www.rbi.org.in/notice'", "'mailto:x'"]),
    "risk": _case("o_orderkey", ["'LOW'", "'HIGH'", "'MEDIUM'", "CAST(NULL AS STRING)", "'INSUFFICIENT'"]),
    "source_type": _case("o_orderkey", ["'PUBLIC_DATASET'", "'SYNTHETIC'", "'LOCAL_DATA'"]),
    "is_example": "o_orderkey % 29 = 0",
    "split": "CASE WHEN o_custkey % 20 < 14 THEN 'train' WHEN o_custkey % 20 < 17 THEN 'validation' ELSE 'test' END",
}
#: One claim for each distinct line number of an order.
CLAIM_TEXTS = [
    "'Earn ₹' || l || '000 monthly, guaranteed 100%'",
    "'Deposit fee of $' || l || ' today only, hurry'",
    "'The shop is not real'",
    "'Work from home if you register'",
    "'Free gift ' || l || ' for 3 days'",
    "'Share the password now'",
]
CLAIMS = {
    "claim_id": "'c' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)",
    "post_id": "'p' || CAST(l_orderkey AS STRING)",
    "claim_no": "l_linenumber",
    "claim_text": _case("(l_orderkey + l_linenumber)", CLAIM_TEXTS).replace("|| l ||", "|| CAST(l_linenumber AS STRING) ||"),
    "claim_type": _case("(l_orderkey + l_linenumber)", ["'FINANCIAL'", "'SHOPPING'", "'other'", "'JOB'", "'GIVEAWAY'", "'CREDENTIAL'"]),
    "language": _case("l_orderkey", ["'en'", "'ta'", "'hi'"]),
    "check_worthiness": "CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_linenumber AS DOUBLE) / 8 END",
}
#: One piece of evidence for each order line, some of which repeat an id.
EVIDENCE = {
    "evidence_id": "'e' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_suppkey % 20 AS STRING)",
    "claim_id": "'c' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)",
    "post_id": "'p' || CAST(l_orderkey AS STRING)",
    "evidence_text": "'Report ' || CAST(l_partkey AS STRING) || ' on part ' || CAST(l_suppkey AS STRING)",
    "relation": "CASE WHEN l_returnflag = 'A' THEN 'SUPPORTS' WHEN l_returnflag = 'R' THEN 'CONTRADICTS' WHEN l_linestatus = 'O' THEN 'NEUTRAL' ELSE 'INSUFFICIENT' END",
    "source_type": _case("l_suppkey", ["'WEB_DOCUMENT'", "'REGULATORY_ALERT'", "'NEWS'", "'Official_Site'", "CAST(NULL AS STRING)"]),
    "source_name": "CASE WHEN l_suppkey % 4 <> 0 THEN 'src' || CAST(l_suppkey % 9 AS STRING) END",
    "source_url": _case("l_partkey", ["'https://News' || CAST(l_suppkey % 13 AS STRING) || '.example.org/a?b'", "CAST(NULL AS STRING)", "'https://tinyurl.com/' || CAST(l_partkey AS STRING)", "'https://sebi.gov.in/' || CAST(l_suppkey AS STRING)", "'  '"]),
}


#: The retrieval set: a claim for each customer, a piece of evidence for each part.
GOODS = ["'red widget'", "'blue bolt'", "'small ring'", "'large gear'"]
TOPICS = {
    "ordinal": "c_custkey",
    "claim_id": "'k' || CAST(c_custkey AS STRING)",
    "claim_text": f"'The ' || lower(c_mktsegment) || ' store unit' || CAST(c_custkey % 50 AS STRING) || ' sells, (daily) a ' || {_case('c_custkey', GOODS)} || ' in zone' || CAST(c_nationkey AS STRING) || CASE WHEN c_custkey % 5 = 0 THEN ' see shop.com now' WHEN c_custkey % 7 = 0 THEN '' ELSE ' at https://x.org/y today ok' END",
    "claim_type": _case("c_custkey", ["'FINANCIAL'", "'OTHER'", "'TEMPORAL'", "'investment'"]),
    "language": _case("c_custkey", ["'en'", "'ta'", "CAST(NULL AS STRING)"]),
    "campaign": "CASE WHEN c_custkey % 9 = 0 THEN 'c' || CAST(c_nationkey AS STRING) END",
    "source_group": "CASE WHEN c_custkey % 3 = 0 THEN 's' || CAST(c_custkey % 40 AS STRING) END",
    "split": "CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'validation' ELSE 'test' END",
}
FINDINGS = {
    "evidence_id": "'v' || CAST(p_partkey AS STRING)",
    "claim_id": "'k' || CAST(p_partkey % 1300 AS STRING)",
    "evidence_text": "CASE WHEN p_partkey % 37 = 0 THEN '  ' ELSE p_name || ' ' || lower(p_type) || ' store unit' || CAST(p_size AS STRING) || ' zone' || CAST(p_partkey % 25 AS STRING) END",
    "relation": _case("p_partkey", ["'SUPPORTS'", "'NEUTRAL'", "'CONTRADICTS'", "'INSUFFICIENT'", "'NEUTRAL'"]),
    "language": _case("p_partkey", ["'en'", "'hi'", "CAST(NULL AS STRING)", "'ta'"]),
}


def topics(t: Tables) -> DataFrame:
    return t("customer").selectExpr(*_columns(TOPICS))


def findings(t: Tables) -> DataFrame:
    return t("part").selectExpr(*_columns(FINDINGS))


def _columns(of: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in of.items()]


def posts(t: Tables, dealt: bool = False) -> DataFrame:
    """Posts, where ``dealt`` lying by ``post_id``: what they are made of is exchanged, no texts, and what is grouped by post or joined to it later needs no other exchange."""
    found = (t("orders") if dealt else spread(t("orders"))).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    if dealt:
        found = found.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment").repartition(F.expr(POSTS["post_id"]))
    return found.selectExpr(*_columns(POSTS))


def lines(t: Tables, *columns: str) -> DataFrame:
    """Order lines with their ``post_id``, by which they are dealt: all that is grouped by post or joined to it later needs no other exchange."""
    post = F.expr(CLAIMS["post_id"])
    return t("lineitem").select(*columns).repartition(post).withColumn("post_id", post)


def claims(t: Tables) -> DataFrame:
    return lines(t, "l_orderkey", "l_linenumber").distinct().selectExpr(*_columns(CLAIMS | {"post_id": "post_id"}))


def evidence(t: Tables) -> DataFrame:
    """The first by content of each id, which stands for an order, a line number and a supplier's remainder: so few numbers of a line are exchanged, no texts."""
    keys = ["evidence_id", "claim_id", "post_id"]
    rest = [c for c in EVIDENCE if c not in keys]
    rows = lines(t, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    first = F.min(F.struct(*(F.coalesce(F.expr(EVIDENCE[c]), F.lit("")).alias(c) for c in rest))).alias("x")
    found = rows.groupBy("post_id", "l_orderkey", "l_linenumber", F.expr("l_suppkey % 20").alias("_supplier")).agg(first)
    ids = {c: EVIDENCE[c].replace("l_suppkey % 20", "_supplier") for c in keys} | {"post_id": "post_id"}
    return found.select(*(F.expr(e).alias(c) for c, e in ids.items()), *(F.nullif(f"x.{c}", F.lit("")).alias(c) for c in rest))


def _select(of: dict[str, str]) -> str:
    return ", ".join(_columns(of))


_REST = [c for c in EVIDENCE if c not in ("evidence_id", "claim_id", "post_id")]
POSTS_SQL = f"posts AS (SELECT {_select(POSTS)} FROM orders JOIN customer ON o_custkey = c_custkey)"
CLAIMS_SQL = f"claims AS (SELECT {_select(CLAIMS)} FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"
EVIDENCE_SQL = f"""evidence AS (SELECT evidence_id, claim_id, post_id, {', '.join(f"nullif({c}, '') AS {c}" for c in _REST)} FROM (
  SELECT evidence_id, claim_id, post_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in _REST)} FROM (SELECT {_select(EVIDENCE)} FROM lineitem))
  QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY {', '.join(_REST)}) = 1)"""
SOCIAL_SQL = f"{POSTS_SQL},\n{CLAIMS_SQL},\n{EVIDENCE_SQL}"
TOPICS_SQL = f"claims AS (SELECT {_select(TOPICS)} FROM customer),\nevidence AS (SELECT {_select(FINDINGS)} FROM part)"
