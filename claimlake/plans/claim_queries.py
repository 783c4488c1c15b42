"""Queries of the claim operators over derived posts, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T
from ..operators import claims
from ..operators.relational import keep_first
from .lineage import spread
from .registry import query
from .social import POSTS_SQL, posts

#: The patterns of this file's SQL (where texts fall apart, types, quantities, frames, times, promises, kinds of queries) are
#: those of ``operators.claims`` and ``functions.text``, written out again so that the SQL stands on its own.
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

def claims_sql(posts_sql: str) -> str:
    return f"{posts_sql},\n{FROM_POSTS}"


FROM_POSTS = rf"""lines AS (SELECT post_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM posts),
cut_lines AS (SELECT post_id, text, li, string_split(regexp_replace({STRIP.format('line')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM lines WHERE {STRIP.format('line')} <> ''),
sentences AS (SELECT post_id, text, li, unnest(s) AS sent, generate_subscripts(s, 1) AS si FROM cut_lines),
cut_sentences AS (
  SELECT *, trim(regexp_extract(sent, '(?i)^([A-Z][a-zA-Z\s]+?)\s+(?:was|has|is|guarantees)', 1)) AS subject,
    CASE WHEN regexp_matches(sent, '(?i)^(if|according to|due to|because)\b') THEN [sent]
    ELSE string_split(regexp_replace(regexp_replace(sent, '(?i),\s+(?:and\s+)?', chr(1), 'g'), '(?i)\s+and\s+((?:has|is|guarantees|was)\b)', chr(1) || '\1', 'g'), chr(1)) END AS p
  FROM sentences WHERE sent <> ''),
pieces AS (SELECT post_id, text, li, si, subject, {STRIP.format('unnest(p)')} AS piece, generate_subscripts(p, 1) AS pi FROM cut_sentences),
clauses AS (
  SELECT post_id, text, row_number() OVER (PARTITION BY post_id ORDER BY li, si, pi) - 1 AS claim_ix,
    CASE WHEN pi > 1 AND subject <> '' AND regexp_matches(piece, '(?i)^(has|is|was|guarantees)\b') THEN subject || ' ' || piece ELSE piece END AS claim_text
  FROM pieces WHERE piece <> ''),
firsts AS (
  SELECT *, trim(regexp_replace(claim_text, '[\s\p{{Z}}]+', ' ', 'g')) AS normalized FROM clauses
  QUALIFY row_number() OVER (PARTITION BY post_id, lower(trim(regexp_replace(claim_text, '[\s\p{{Z}}]+', ' ', 'g'))) ORDER BY claim_ix) = 1),
quantities AS (
  SELECT *, nullif(regexp_extract(claim_text, '(?i)\b\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?\b'), '') AS number, nullif(regexp_extract(claim_text, '\d+(?:\.\d+)?\s*%'), '') AS percent,
    nullif(regexp_extract(claim_text, '(?i)(?:₹|\$|rs\.?|rupees?|dollars?)\s*\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?|\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?\s*(?:₹|\$|rs\.?|rupees?|dollars?)'), '') AS amount
  FROM firsts),
typed AS (
  SELECT *, CASE WHEN contains(claim_text, '?') THEN 'QUESTION'
    WHEN regexp_matches(claim_text, '(?i)\b(i think|i feel|maybe|probably)\b') THEN 'OPINION'
    WHEN regexp_matches(claim_text, '(?i)\b(dm me|message me|send|provide|give|whatsapp me)\b') THEN 'REQUEST'
    WHEN regexp_matches(claim_text, '(?i)\b(apply|click|register|join|share)\b') THEN 'INSTRUCTION'
    WHEN regexp_matches(claim_text, '(?i)\b(received|saw|found|message yesterday)\b') THEN 'CONTEXTUAL'
    WHEN regexp_matches(claim_text, '(?i)\b(guarantee|guarantees|assured|100%|sure)\b') THEN 'GUARANTEE'
    WHEN regexp_matches(claim_text, '(?i)(₹|\$|earn|earns|profit|return|returns|money|pay|fee|income|investment|invest|receive)') THEN 'FINANCIAL'
    WHEN regexp_matches(claim_text, '(?i)\b(customers|users|people|employees)\b') AND (number IS NOT NULL OR percent IS NOT NULL) THEN 'NUMERICAL'
    WHEN regexp_matches(claim_text, '(?i)\b(founded|headquartered_in|headquarters|approved|registered|located|owns|operates|has)\b') THEN 'FACTUAL'
    WHEN number IS NOT NULL OR amount IS NOT NULL OR percent IS NOT NULL THEN 'NUMERICAL' ELSE 'FACTUAL' END AS claim_type,
    nullif(trim(regexp_extract(claim_text, '(?i)(according to|stated by|claimed by)\s+([^,.]+)', 2)), '') AS attribution
  FROM quantities)"""

CLAIMS = claims_sql(POSTS_SQL)

NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY claim_ix) AS k FROM typed),
spans(post_id, k, pos, span_start, span_end) AS (
  SELECT DISTINCT post_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM numbered
  UNION ALL
  SELECT n.post_id, n.k, CASE WHEN instr(substr(n.text, s.pos + 1), n.claim_text) > 0 THEN s.pos + instr(substr(n.text, s.pos + 1), n.claim_text) - 1 + length(n.claim_text) ELSE s.pos END,
    CASE WHEN instr(substr(n.text, s.pos + 1), n.claim_text) > 0 THEN s.pos + instr(substr(n.text, s.pos + 1), n.claim_text) - 1 ELSE 0 END,
    CASE WHEN instr(substr(n.text, s.pos + 1), n.claim_text) > 0 THEN s.pos + instr(substr(n.text, s.pos + 1), n.claim_text) - 1 ELSE 0 END + length(n.claim_text)
  FROM spans s JOIN numbered n ON n.post_id = s.post_id AND n.k = s.k + 1)"""

SPANS = f"""WITH RECURSIVE {CLAIMS}, {NUMBERED}
SELECT post_id, claim_ix::INTEGER AS claim_ix, claim_text, span_start::INTEGER AS span_start, span_end::INTEGER AS span_end, claim_type, claim_type NOT IN ('QUESTION', 'OPINION', 'REQUEST', 'INSTRUCTION', 'CONTEXTUAL') AS verifiable,
  number AS first_number, amount AS first_amount, percent AS first_percent, attribution FROM numbered JOIN spans USING (post_id, k)"""


def by_text(t, work=lambda rows: rows):  # noqa: ANN001, ANN201
    """``work`` on the typed claims of all posts."""
    return claims.by_text(posts(t), "post_id", "text", lambda texts: work(claims.typed(claims.extract(texts, "post_id", "text"))))


@query(SPANS)
def k1_k2_k5_w5_extracted_claims(t):
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return by_text(t).select("post_id", "claim_ix", "claim_text", "span_start", "span_end", "claim_type", "verifiable", first("numbers").alias("first_number"), first("amounts").alias("first_amount"), first("percents").alias("first_percent"), "attribution")


CONVERSATIONS = "posts AS (SELECT conv_id * 1000 + turn AS post_id, text FROM conversations)"


@query(f"""WITH RECURSIVE {claims_sql(CONVERSATIONS)}, {NUMBERED}
SELECT post_id, claim_ix::INTEGER AS claim_ix, claim_text, normalized, span_start::INTEGER AS span_start, span_end::INTEGER AS span_end FROM numbered JOIN spans USING (post_id, k)""")
def y5_k1_conversation_claims(t):
    """Through the table function."""
    rows = spread(t("conversations").selectExpr("conv_id * 1000 + turn AS post_id", "text"))
    segment = udtf(claims.SegmentClaims, returnType=claims.SegmentClaims.RETURNS)
    return rows.lateralJoin(segment(F.col("text").outer())).drop("text")


@query(f"""WITH {claims_sql("posts AS (SELECT doc_id AS post_id, text FROM documents)")}
SELECT post_id, claim_ix::INTEGER AS claim_ix, normalized, claim_type, number AS first_number, amount AS first_amount, percent AS first_percent, attribution FROM typed""")
def k1_k2_k5_document_claims(t):
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    rows = claims.typed(claims.extract(spread(t("documents").select("doc_id", "text")), "doc_id", "text", T.ASCII_EDGE, spans=False), T.ASCII_EDGE)
    return rows.select("post_id", "claim_ix", "normalized", "claim_type", first("numbers").alias("first_number"), first("amounts").alias("first_amount"), first("percents").alias("first_percent"), "attribution")


ATOMS = rf"""{CLAIMS},
split AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(normalized, '(?i)\b(?:and|but|while)\b|।|\s+(?:और)\s+', chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: length(x) > 3) AS parts,
    regexp_extract(claim_text, '(?i)(?:if\s+(?:you\s+)?)?invest\s+(.*?)\s+(today|tomorrow).*?receive\s+(.*?)\s+(within\s+\d+\s+days|after\s+\d+\s+days)', ['a', 'b', 'c', 'd']) AS en,
    regexp_extract(claim_text, '(?i)(आज|today)\s+(₹[\d,]+)\s*(?:निवेश करने पर|invest).*?(\d+\s*दिनों के भीतर|within \d+ days)\s+(₹[\d,]+)', ['b', 'a', 'd', 'c']) AS hi,
    (contains(lower(normalized), 'invest') AND contains(lower(normalized), 'receive')) OR contains(normalized, 'निवेश करने पर') AS asked
  FROM typed),
chosen AS (SELECT *, CASE WHEN asked AND en.a <> '' THEN en WHEN asked AND hi.a <> '' THEN hi END AS pr FROM split),
rows_ AS (
  SELECT *, unnest(CASE WHEN pr IS NOT NULL THEN ['invests', 'receives'] WHEN len(parts) > 1 THEN parts ELSE [normalized] END) AS item,
    unnest(range(CASE WHEN pr IS NOT NULL THEN 2 WHEN len(parts) > 1 THEN len(parts) ELSE 1 END)) AS part_ix FROM chosen),
framed AS (
  SELECT *, CASE WHEN pr IS NULL THEN item ELSE normalized END AS x,
    CASE WHEN pr IS NOT NULL THEN -1 WHEN contains(lower(item), 'founded in') THEN 1 WHEN contains(lower(item), 'has') AND contains(lower(item), 'customers') THEN 2 WHEN contains(lower(item), 'headquarters') THEN 3
      WHEN contains(lower(item), 'guarantees') AND contains(lower(item), 'returns') THEN 4 WHEN contains(item, 'रिटर्न की गारंटी') OR contains(lower(item), 'return guarantee') THEN 5
      WHEN contains(lower(item), 'government approved') OR contains(lower(item), 'approved by') THEN 6 ELSE 0 END AS f FROM rows_),
fitted AS (
  SELECT *, CASE f WHEN 1 THEN regexp_extract(x, '(?i)(.*?)\s+was founded in\s+(\d{{4}})', ['s', 'v']) WHEN 2 THEN regexp_extract(x, '(?i)(.*?)\bhas\s+([\d,]+)\s+customers', ['s', 'v'])
      WHEN 3 THEN regexp_extract(x, '(?i)(.*?)\s+headquarters are in\s+(.*?)(?:\.|$)', ['s', 'v']) WHEN 4 THEN regexp_extract(x, '(?i)(.*?)\s+guarantees\s+([\d.]+)\s*%\s*(?:monthly|yearly|annually)?\s*returns', ['s', 'v'])
      WHEN 5 THEN regexp_extract(x, '(?i)(.*?)\s+(?:हर महीने|monthly)\s*([\d.]+)%?\s*(?:रिटर्न की गारंटी देता है|return guarantee pannudhu)', ['s', 'v'])
      WHEN 6 THEN regexp_extract(x, '(?i)(.*?)\s+(?:is|are|really)\s*(?:not\s*)?((?:government approved|approved by the government))', ['s', 'v']) END AS g FROM framed),
valued AS (
  SELECT *, CASE WHEN pr IS NOT NULL THEN item WHEN g.v <> '' THEN ['founded', 'has', 'headquartered_in', 'guarantees', 'guarantees', 'government_approved'][f] END AS predicate,
    CASE WHEN pr IS NOT NULL THEN CASE WHEN item = 'invests' THEN pr.a ELSE pr.c END WHEN g.v <> '' AND f = 3 THEN g.v WHEN g.v <> '' AND f IN (4, 5) THEN 'returns' END AS object,
    CASE WHEN g.v <> '' AND f IN (1, 2, 4, 5) THEN replace(g.v, ',', '') END AS frame_value,
    CASE WHEN pr IS NULL THEN nullif({STRIP.format("CASE WHEN f = 5 AND g.v <> '' AND trim(g.s) = '' THEN 'ABC Wealth' WHEN g.v <> '' THEN g.s END")}, '') END AS raw,
    pr IS NULL AND regexp_matches(x, '(?i)\b(not|no|never)\b') AS negated,
    lower(regexp_extract(x, '(?i)\b(today|tomorrow|yesterday|monthly|yearly|annually|in \d+ days|within \d+ days|after \d+ days|since \d{{4}}|by [a-z]+ \d{{4}})\b', 1)) AS time
  FROM fitted),
carried AS (
  SELECT *, coalesce(last_value(CASE WHEN lower(raw) NOT IN ('the company', 'its', 'it', 'they', 'this company') THEN raw END IGNORE NULLS) OVER w,
    first_value(CASE WHEN lower(raw) IN ('the company', 'its', 'it', 'they', 'this company') THEN raw END IGNORE NULLS) OVER w) AS known
  FROM valued WINDOW w AS (PARTITION BY post_id ORDER BY claim_ix, part_ix ROWS UNBOUNDED PRECEDING)),
atoms AS (
  SELECT post_id, claim_ix::INTEGER AS claim_ix, part_ix::INTEGER AS part_ix, claim_text, claim_type, x AS atom_text, claim_type NOT IN ('QUESTION', 'OPINION', 'REQUEST', 'INSTRUCTION', 'CONTEXTUAL') AS verifiable,
    CASE WHEN pr IS NOT NULL OR len(parts) > 1 THEN 'success' ELSE 'unchanged' END AS status,
    CASE WHEN pr IS NOT NULL THEN 'investor' ELSE nullif({STRIP.format("regexp_replace(known, '(?i)^is\\s+', '')")}, '') END AS subject, predicate, object,
    CASE WHEN pr IS NOT NULL THEN regexp_replace(object, '[^\d.]', '', 'g') WHEN frame_value IS NOT NULL THEN frame_value WHEN percent IS NOT NULL THEN {STRIP.format("replace(percent, '%', '')")}
      WHEN amount IS NOT NULL THEN regexp_replace(amount, '[^\d.]', '', 'g') WHEN NOT (number = '2018' AND contains(lower(x), 'founded')) THEN number END AS value,
    CASE WHEN pr IS NOT NULL THEN NULL WHEN frame_value IS NOT NULL THEN ['year', 'customers', NULL, 'percent', 'percent', NULL][f] WHEN percent IS NOT NULL THEN 'percent' END AS unit,
    CASE WHEN pr IS NOT NULL THEN CASE WHEN contains(object, '₹') THEN 'INR' END WHEN frame_value IS NOT NULL OR percent IS NOT NULL THEN NULL
      WHEN contains(amount, '₹') OR contains(lower(amount), 'rs') THEN 'INR' WHEN contains(amount, '$') THEN 'USD' END AS currency,
    CASE WHEN negated THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity,
    CASE WHEN pr IS NOT NULL THEN CASE WHEN item = 'invests' THEN 'date' ELSE 'deadline' END WHEN contains(time, 'within') OR contains(time, 'after') OR contains(time, 'in') THEN 'deadline' WHEN time = 'today' THEN 'today' WHEN time <> '' THEN 'frequency' END AS time_kind,
    CASE WHEN pr IS NOT NULL THEN CASE WHEN item = 'invests' THEN pr.b ELSE pr.d END ELSE nullif(time, '') END AS time_value, number IS NOT NULL OR amount IS NOT NULL AS quantified
  FROM carried)"""


@query(f"WITH {ATOMS} SELECT * EXCLUDE (quantified) FROM atoms")
def k6_k7_k8_k9_k11_w4_atoms(t):
    return by_text(t, claims.atoms).drop("negated", "numbers", "amounts")


QUERIES_SQL = f"""{ATOMS},
asked AS (
  SELECT *, contains(lower(claim_text), 'government') OR contains(lower(claim_text), 'approv') OR contains(lower(claim_text), 'register') AS official FROM atoms WHERE verifiable OR claim_type = 'QUESTION'),
worded AS (
  SELECT post_id, claim_ix, part_ix, claim_type, official,
    {STRIP.format('''CASE WHEN official THEN coalesce(subject || ' ', '') || 'government approval registration' WHEN claim_type = 'FACTUAL' AND predicate = 'founded' AND subject IS NOT NULL THEN subject || ' founded ' || coalesce(value, '')
      WHEN claim_type = 'FACTUAL' AND predicate = 'headquartered_in' AND subject IS NOT NULL THEN subject || ' headquarters ' || coalesce(object, '') WHEN claim_type = 'NUMERICAL' AND subject IS NOT NULL AND value <> '' THEN subject || ' ' || value || ' ' || coalesce(unit, '')
      WHEN claim_type = 'GUARANTEE' AND subject IS NOT NULL THEN subject || ' ' || coalesce(value, '') || ' percent ' || coalesce(time_value, '') || ' returns' ELSE claim_text END''')} AS query_text,
    CASE WHEN official OR claim_type = 'QUESTION' THEN 'REGISTRATION_VERIFICATION' WHEN claim_type = 'FACTUAL' AND predicate = 'founded' AND subject IS NOT NULL THEN 'TEMPORAL_VERIFICATION'
      WHEN claim_type = 'FACTUAL' AND predicate = 'headquartered_in' AND subject IS NOT NULL THEN 'ENTITY_VERIFICATION' WHEN claim_type = 'FACTUAL' THEN 'DIRECT_VERIFICATION' WHEN claim_type = 'NUMERICAL' THEN 'NUMERICAL_VERIFICATION' ELSE 'FINANCIAL_VERIFICATION' END AS query_type,
    CASE WHEN official THEN 'official_government,regulatory_databases' WHEN claim_type = 'QUESTION' THEN 'official_government' WHEN claim_type = 'FACTUAL' THEN 'general_web,reputable_news' WHEN claim_type = 'NUMERICAL' THEN 'official_company'
      WHEN claim_type = 'GUARANTEE' THEN 'official_company,financial_regulator' ELSE 'official_company,authoritative_financial' END AS sources
  FROM asked),
queries AS (SELECT post_id, claim_ix, part_ix, query_text, query_type, 'HIGH' AS priority, sources FROM worded QUALIFY row_number() OVER (PARTITION BY post_id, lower(query_text), query_type ORDER BY claim_ix, part_ix) = 1)"""


@query(f"WITH {QUERIES_SQL} SELECT * FROM queries")
def k12_w1_search_queries(t):
    return by_text(t, lambda rows: claims.search_queries(claims.atoms(rows))).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {QUERIES_SQL},
counts AS (SELECT p.post_id, (SELECT count(*) FROM typed c WHERE c.post_id = p.post_id) AS extracted_count, (SELECT count(*) FROM atoms a WHERE a.post_id = p.post_id) AS atomic_count, (SELECT count(*) FROM queries q WHERE q.post_id = p.post_id) AS queries_count FROM posts p)
SELECT *, CASE WHEN extracted_count = 0 THEN 'No claims extracted from post.' WHEN queries_count = 0 AND atomic_count > 0 THEN 'No queries generated despite having atomic claims.' ELSE '' END AS warnings FROM counts""")
def k13_claim_pipeline(t):
    return claims.pipeline(posts(t), "post_id", "text").withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""WITH {ATOMS},
by_claim AS (
  SELECT post_id, claim_ix, count(*) AS n, count(*) FILTER (verifiable) AS v, count(*) FILTER (verifiable AND predicate IS NULL) AS p, count(*) FILTER (verifiable AND subject IS NULL) AS s, bool_or(verifiable AND quantified) AS wants, bool_or(coalesce(value, '') <> '') AS has,
    max(CASE WHEN predicate = 'invests' THEN value END) AS paid, max(CASE WHEN predicate = 'receives' THEN value END) AS got, bool_or(regexp_matches(claim_text, '20000|20,000')) AS more FROM atoms GROUP BY post_id, claim_ix)
SELECT post_id, sum(n)::BIGINT AS atoms, sum(v)::BIGINT AS verifiable, sum(p)::BIGINT AS missing_predicates, sum(s)::BIGINT AS missing_subjects, count(*) FILTER (wants AND NOT has) AS without_value, count(*) FILTER (paid = got AND paid = '10000' AND more) AS repeated_values,
  sum(p) + sum(s) + count(*) FILTER (wants AND NOT has) + count(*) FILTER (paid = got AND paid = '10000' AND more) = 0 AS ready FROM by_claim GROUP BY post_id""")
def p26_quality_gate(t):
    return by_text(t, lambda rows: claims.quality_gate(claims.atoms(rows)))


@query(f"WITH {POSTS_SQL}, first AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY username, platform ORDER BY ordinal DESC) = 1) SELECT username, platform, post_id FROM first WHERE username IS NOT NULL")
def w1_w3_keep_last(t):
    rows = posts(t).filter("username is not null")
    return keep_first(rows, ["username", "platform"], [F.desc("ordinal")]).select("username", "platform", "post_id")
