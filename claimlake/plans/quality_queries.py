"""Queries of quality control, linking, recognition and evaluation over derived tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as claim_ops
from ..operators import metrics, quality, recognition, relational
from . import claim_queries
from .claim_queries import ATOMS
from .registry import query
from .social import CLAIMS_SQL, EVIDENCE_SQL, POSTS_SQL, SOCIAL_SQL, TOPICS_SQL, claims, evidence, findings, posts, topics

# Linking and references


@query(rf"""WITH RECURSIVE {POSTS_SQL},
signals AS (SELECT *, coalesce(campaign, 'camp_' || coalesce('upi:' || nullif(lower(regexp_extract(text, '(?i)([\w.\-]+@(?:okhdfcbank|okaxis|oksbi|paytm|ybl|upi|apl))', 1)), ''), 'domain:' || nullif(lower(regexp_extract(text, '(?i)https?://(?:www\.)?([^\s/?]+)', 1)), ''), 'phone:' || nullif(regexp_extract(text, '((?:\+91|0)?[6-9]\d{{9}})', 1), ''))) AS camp FROM posts),
links AS (SELECT ordinal, 'S' || username AS k FROM signals WHERE username IS NOT NULL UNION SELECT ordinal, 'C' || camp FROM signals WHERE camp IS NOT NULL UNION SELECT ordinal, 'F' || family FROM signals WHERE family IS NOT NULL UNION SELECT ordinal, 'I' || image FROM signals WHERE image IS NOT NULL AND ordinal % 2 = 0 UNION SELECT ordinal, 'T' || translation FROM signals WHERE translation IS NOT NULL),
near AS (SELECT DISTINCT a.ordinal AS a, b.ordinal AS b FROM links a JOIN (SELECT k, min(ordinal) AS ordinal FROM links GROUP BY k) b USING (k)),
sides AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT ordinal AS id, ordinal AS c FROM posts UNION SELECT s.b, r.c FROM reach r JOIN sides s ON s.a = r.id WHERE r.c < s.b)
SELECT post_id, min(c) AS cluster FROM reach JOIN posts ON ordinal = id GROUP BY post_id""")
def c1_c2_c3_linked_posts(t):
    rows = posts(t).withColumn("image_family", F.when(F.col("ordinal") % 2 == 0, F.col("image")))
    return quality.linked_posts(rows)


@query(f"""WITH {TOPICS_SQL}, e AS (SELECT *, CASE relation WHEN 'SUPPORTS' THEN 0 WHEN 'CONTRADICTS' THEN 1 WHEN 'NEUTRAL' THEN 2 ELSE 3 END::INTEGER AS label FROM evidence)
SELECT evidence_id AS pair_id, coalesce(c.claim_text, '') AS claim_text, evidence_text, label, coalesce(c.language, 'unknown') AS claim_language, coalesce(e.language, 'unknown') AS evidence_language, coalesce(c.language <> e.language, false) AS cross_language FROM e LEFT JOIN claims c USING (claim_id)""")
def j15_verification_pairs(t):
    return quality.verification_pairs(topics(t), findings(t))


@query(f"WITH {ATOMS}, x AS (SELECT post_id, claim_ix, max(CASE WHEN predicate = 'invests' THEN value END) AS paid, max(CASE WHEN predicate = 'receives' THEN value END) AS got, max(CASE WHEN predicate = 'receives' THEN time_value END) AS w FROM atoms GROUP BY post_id, claim_ix) SELECT post_id, claim_ix, 'investment ' || paid || ' promised return ' || got || ' ' || w AS query_text FROM x WHERE paid IS NOT NULL")
def j14_conditional_pairs(t):
    return claim_queries.by_text(t, lambda rows: quality.conditional_pairs(claim_ops.atoms(rows)))


REGISTRY = "SELECT s_name AS source_name, CASE WHEN s_suppkey % 3 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'CC-BY' END AS license FROM supplier"
MADE = "SELECT l_orderkey, l_linenumber, 'Supplier#' || lpad((l_suppkey * 2)::VARCHAR, 9, '0') AS source_name FROM lineitem"


@query(f"WITH r AS ({REGISTRY}), p AS ({MADE}) SELECT source_name, count(*) AS posts FROM p WHERE source_name NOT IN (SELECT source_name FROM r WHERE status = 'APPROVED') GROUP BY source_name")
def j16_unapproved_sources(t):
    registry = t("supplier").selectExpr("s_name AS source_name", "CASE WHEN s_suppkey % 3 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status")
    rows = t("lineitem").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") * 2).cast("string"), 9, "0")).alias("source_name"))
    return quality.unapproved(rows, registry).groupBy("source_name").agg(F.count("*").alias("posts"))


@query(f"WITH r AS ({REGISTRY}) SELECT source_name, upper(coalesce(license, 'UNSPECIFIED')) NOT IN ('UNSPECIFIED', 'UNKNOWN', 'PENDING_REVIEW') AS licence_valid FROM r WHERE status = 'APPROVED'")
def s21_permitted_sources(t):
    from ..sources.files import permitted_sources

    registry = t("supplier").selectExpr("s_name AS source_name", "CASE WHEN s_suppkey % 3 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status", "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'CC-BY' END AS license")
    return permitted_sources(registry).select("source_name", "licence_valid")


# Audits


@query(f"WITH {SOCIAL_SQL} SELECT 'MEDIUM' AS audit, language AS value, count(*) AS n FROM posts WHERE risk = 'MEDIUM' GROUP BY language UNION ALL SELECT 'MEDIUM', split, count(*) FROM posts WHERE risk = 'MEDIUM' GROUP BY split UNION ALL SELECT 'NEUTRAL', p.split, count(*) FROM evidence e JOIN posts p USING (post_id) WHERE relation = 'NEUTRAL' GROUP BY p.split")
def a5_filtered_audits(t):
    medium = relational.distributions(posts(t).filter("risk = 'MEDIUM'"), ["language", "split"]).select(F.lit("MEDIUM").alias("audit"), "value", "n")
    neutral = evidence(t).filter("relation = 'NEUTRAL'").join(posts(t).select("post_id", "split"), "post_id")
    return medium.unionByName(relational.distributions(neutral, ["split"]).select(F.lit("NEUTRAL").alias("audit"), "value", "n"))


@query(f"WITH {POSTS_SQL} SELECT count(*) AS discovered, count(*) FILTER (text <> '') AS valid, count(*) FILTER (text = '') AS invalid, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT language) AS languages FROM posts")
def a23_s19_collection_summary(t):
    text = F.col("text")
    return posts(t).agg(F.count("*").alias("discovered"), F.count_if(text != "").alias("valid"), F.count_if(text == "").alias("invalid"), (F.count("*") - F.count_distinct("text")).alias("duplicates"), F.count_distinct("language").alias("languages"))


@query(f"WITH {POSTS_SQL}, s AS (SELECT username, list_sort(list(DISTINCT split)) AS splits FROM posts WHERE username IS NOT NULL GROUP BY username), f AS (SELECT family, list_sort(list(DISTINCT split)) AS splits FROM posts WHERE family IS NOT NULL GROUP BY family) SELECT 'username' AS kind, username AS key, array_to_string(splits, ',') AS splits FROM s WHERE len(splits) > 1 UNION ALL SELECT 'family', family, array_to_string(splits, ',') FROM f WHERE len(splits) > 1")
def c7_a9_split_audit(t):
    parts = [relational.leakage(posts(t), k).select(F.lit(k).alias("kind"), F.col(k).alias("key"), F.array_join("splits", ",").alias("splits")) for k in ("username", "family")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {POSTS_SQL} SELECT split, source_type = 'SYNTHETIC' OR is_example AS synthetic, count(*) AS n FROM posts GROUP BY ALL")
def p18_p21_synthetic_by_split(t):
    return posts(t).withColumn("synthetic", quality.is_synthetic("is_example", "source_type")).groupBy("split", "synthetic").agg(F.count("*").alias("n"))


@query(f"WITH {POSTS_SQL} SELECT platform, array_to_string(list_filter(['HIGH', 'LOW', 'MEDIUM', 'INSUFFICIENT'], lambda x: NOT coalesce(list_contains(list(DISTINCT risk), x), false)), ',') AS missing FROM posts GROUP BY platform")
def u4_required_classes(t):
    required = F.array(*map(F.lit, ["HIGH", "LOW", "MEDIUM", "INSUFFICIENT"]))
    return posts(t).groupBy("platform").agg(F.array_join(F.array_except(required, F.collect_set("risk")), ",").alias("missing"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2)) AS w FROM benchmark)
SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def u3_neighbour_jaccard(t):
    a = t("benchmark").select("item_id", T.word_set("text").alias("a"))
    b = t("benchmark").select((F.col("item_id") - 1).alias("item_id"), T.word_set("text").alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(T.jaccard("a", "b"), 6).alias("similarity"))


@query(f"""WITH {POSTS_SQL} SELECT post_id, source_type IN ('PUBLIC_DATASET', 'SYNTHETIC', 'LOCAL_DATA') AND username IS NOT NULL AS valid, CASE WHEN username IS NOT NULL THEN coalesce(campaign, 'UNSPECIFIED') END AS license FROM posts""")
def p9_p10_provenance(t):
    out = posts(t).withColumns({"method": F.lit("manual"), "kind": F.lower("source_type")}).withColumn("p", quality.provenance("kind", "username", "method", "campaign"))
    return out.select("post_id", F.col("p").isNotNull().alias("valid"), F.col("p.license").alias("license"))


@query(f"""WITH {POSTS_SQL} SELECT post_id, CASE WHEN text = '' THEN 'MISSING_CANONICAL_TEXT,' ELSE '' END || CASE WHEN username IS NULL THEN 'MISSING_PROVENANCE,' ELSE '' END || CASE WHEN language = 'fr' THEN 'INVALID_LANGUAGE,' ELSE '' END AS reasons FROM posts""")
def p17_post_checks(t):
    out = quality.check_posts(posts(t).withColumns({"source_name": F.col("username"), "language": F.when(F.col("language") != "fr", F.col("language"))}))
    return out.select("post_id", F.concat_ws("", F.transform("reasons", lambda r: F.concat(r, F.lit(",")))).alias("reasons"))


@query(f"""WITH {EVIDENCE_SQL}, {CLAIMS_SQL} SELECT evidence_id, (claim_id LIKE '%_7')::INT + (relation = 'NEUTRAL')::INT AS n_reasons FROM evidence""")
def p17_j5_evidence_checks(t):
    """Claims on line 7 are not known, and one relation is taken for a wrong one."""
    rows = evidence(t).withColumn("relation", F.when(F.col("relation") == "NEUTRAL", "MAYBE").otherwise(F.col("relation")))
    out = quality.check_evidence(rows, claims(t).filter(~F.col("claim_id").endswith("_7")))
    return out.select("evidence_id", F.size("reasons").alias("n_reasons"))


EVENT = "CASE (event_id + user_id) % 7 WHEN 0 THEN 'assign' WHEN 1 THEN 'submit' WHEN 2 THEN 'accept' WHEN 3 THEN 'flag' WHEN 4 THEN 'reject' ELSE 'assign' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS task, {EVENT} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s(task, k, status, submissions, rejected) AS (
  SELECT DISTINCT task, 0::BIGINT, 'PENDING', 0::BIGINT, 0::BIGINT FROM e
  UNION ALL SELECT s.task, e.k, CASE WHEN (kind = 'assign' AND status NOT IN ('PENDING', 'NEEDS_REVIEW')) OR (kind = 'accept' AND submissions = 0) THEN status ELSE CASE kind WHEN 'assign' THEN 'IN_PROGRESS' WHEN 'submit' THEN 'SUBMITTED' WHEN 'accept' THEN 'ACCEPTED' WHEN 'reject' THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END END,
    submissions + (kind = 'submit')::BIGINT, rejected + ((kind = 'assign' AND status NOT IN ('PENDING', 'NEEDS_REVIEW')) OR (kind = 'accept' AND submissions = 0))::BIGINT FROM s JOIN e ON e.task = s.task AND e.k = s.k + 1)
SELECT task, status, submissions, rejected AS rejected_events FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY k DESC) = 1""")
def w12_task_states(t):
    rows = t("events").select(F.col("user_id").alias("task"), F.struct("ts", "event_id").alias("at"), F.expr(EVENT).alias("kind"))
    return quality.task_states(rows, "task", "at", "kind")


# Recognised text

CANDIDATE = {
    "image": "o_custkey", "ordinal": "o_orderkey", "mode": "CASE WHEN o_orderkey % 2 = 0 THEN 'ta' ELSE 'en' END", "confidence": "CAST(o_orderkey % 101 AS DOUBLE) / 100", "detections": "o_orderkey % 13",
    "text": "CASE o_orderkey % 7 WHEN 0 THEN 'தமிழ் உரை ' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'Seen on the wall of ' || o_orderpriority || ' shops, with a long line of letters' WHEN 2 THEN '  ' WHEN 3 THEN '!? ~~ ^^' WHEN 4 THEN '12' WHEN 5 THEN 'தமிழ் and English' ELSE '~~ ^^ ~~ a' END",
}
CANDIDATES_SQL = "cand AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CANDIDATE.items()) + " FROM orders)"
_B = r"regexp_replace(text, '[\s\p{Z}]+', '', 'g')"


def _share(cls: str) -> str:
    return f"(CASE WHEN length({_B}) > 0 THEN length(regexp_replace({_B}, '[^{cls}]', '', 'g')) / length({_B}) ELSE 0.0 END)"


TA, LA, VALID, ALNUM = (_share(c) for c in (r"\x{0B80}-\x{0BFF}", r"A-Za-z\x{00C0}-\x{024F}", r"\x{0B80}-\x{0BFF}A-Za-z0-9\x{00C0}-\x{024F}₹$€£.,!?:;''\"()\-/%@#&+", r"\p{L}\p{N}"))
SCORED = f"""{CANDIDATES_SQL}, scored AS (SELECT *, trim(text) <> '' AND confidence >= 0.60 AND (mode <> 'ta' OR {TA} > 0) AS usable,
  round(0.45 * confidence + 0.25 * (CASE WHEN mode = 'ta' THEN {TA} ELSE {LA} END) + 0.15 * least(length(text) / 50, 1.0) + 0.15 * least(detections / 10, 1.0), 4) AS score FROM cand)"""


def candidates(t):  # noqa: ANN001, ANN201
    return t("orders").selectExpr(*(f"{e} AS {n}" for n, e in CANDIDATE.items()))


@query(f"WITH {SCORED} SELECT ordinal, usable, score FROM scored")
def q1_q2_candidate_scores(t):
    return candidates(t).select("ordinal", recognition.usable("text", "confidence", "mode").alias("usable"), recognition.selection_score("text", "confidence", "mode", "detections").alias("score"))


@query(rf"""WITH {CANDIDATES_SQL}, w AS (SELECT ordinal, confidence, mode, detections, trim(text) AS x, {TA} AS ta, {VALID} AS valid, {ALNUM} AS alnum FROM cand)
SELECT ordinal, array_to_string(list_filter([CASE WHEN confidence < 0.60 THEN 'confidence_below_gate:' || printf('%.3f', confidence) END, CASE WHEN x = '' THEN 'empty_ocr_output' END, CASE WHEN x <> '' AND alnum < 0.30 THEN 'low_alphanumeric_ratio:' || printf('%.3f', alnum) END,
 CASE WHEN x <> '' AND valid < 0.40 THEN 'low_valid_char_ratio:' || printf('%.3f', valid) END, CASE WHEN x <> '' AND mode = 'ta' AND ta < 0.05 THEN 'tamil_ocr_no_tamil_chars' END, CASE WHEN x <> '' AND mode = 'en' AND ta > 0.50 THEN 'english_ocr_high_tamil_ratio' END,
 CASE WHEN x <> '' AND detections > 5 AND length(x) < 10 THEN 'suspiciously_short_text_for_detection_count' END], lambda c: c IS NOT NULL), ',') AS warnings FROM w""")
def q3_l9_candidate_warnings(t):
    return candidates(t).select("ordinal", F.array_join(recognition.warnings("text", "confidence", "mode", "detections"), ",").alias("warnings"))


@query(f"WITH {SCORED} SELECT image, ordinal, usable, score FROM scored QUALIFY row_number() OVER (PARTITION BY image ORDER BY usable DESC, (trim(text) <> '') DESC, score DESC, ordinal) = 1")
def q4_o5_best_candidate(t):
    return recognition.best_candidate(candidates(t), "image", "text", "confidence", "mode", "detections", "ordinal").select("image", "ordinal", "usable", "score")


@query(f"""WITH {CANDIDATES_SQL}, r AS (SELECT ordinal, text, {TA} AS ta, {VALID} AS valid, confidence, mode, detections FROM cand),
s AS (SELECT *, round(least(greatest(0.40 * confidence + 0.20 * (CASE WHEN mode = 'ta' THEN ta ELSE 1 - ta END) + 0.20 * valid + 0.10 * least(length(trim(text)) / 50, 1.0) + 0.10 * (CASE WHEN detections > 0 THEN 0.6 * confidence + 0.4 * least(detections / 10, 1.0) ELSE 0.0 END), 0.0), 1.0), 4) AS reliability FROM r)
SELECT ordinal, reliability, CASE WHEN trim(text) = '' THEN 'OCR_FAILED' WHEN length(trim(text)) < 3 THEN 'PARTIAL' WHEN ta = 0 AND valid < 0.10 THEN 'LANGUAGE_UNCERTAIN' WHEN reliability < 0.45 THEN 'LOW_CONFIDENCE' ELSE 'SUCCESS' END AS status FROM s""")
def q5_q6_reliability(t):
    rows = candidates(t).withColumn("regions", F.array_repeat("confidence", F.col("detections").cast("int")))
    score = recognition.reliability("text", "confidence", "regions", "mode")
    return rows.withColumn("reliability", score).select("ordinal", "reliability", recognition.status("text", F.col("reliability")).alias("status"))


@query(f"""WITH {CANDIDATES_SQL}, f AS (SELECT ordinal, text, confidence, 0.40 * confidence + 0.25 * (1 - {TA}) + 0.20 * {VALID} + 0.15 * least(length(trim(text)) / 50, 1.0) AS en, 0.40 * confidence + 0.25 * {TA} + 0.20 * {VALID} + 0.15 * least(length(trim(text)) / 50, 1.0) AS ta FROM cand)
SELECT a.ordinal, CASE WHEN b.text <> '' AND b.ta > a.en THEN 'ta' ELSE 'en' END AS chosen FROM f a JOIN f b ON b.ordinal = a.ordinal + 1""")
def q7_fused_choice(t):
    a = candidates(t).select("ordinal", F.col("text").alias("en_text"), F.col("confidence").alias("en_conf"))
    b = candidates(t).select((F.col("ordinal") - 1).alias("ordinal"), F.col("text").alias("ta_text"), F.col("confidence").alias("ta_conf"))
    return recognition.fused_choice(a.join(b, "ordinal"), ("en_text", "en_conf"), ("ta_text", "ta_conf")).select("ordinal", "chosen")


@query(f"WITH {CANDIDATES_SQL} SELECT ordinal, CASE WHEN trim(text) = '' THEN 'failed' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.60 THEN 'medium' ELSE 'low' END AS level FROM cand")
def p16_quality_level(t):
    return candidates(t).select("ordinal", recognition.quality_level("text", "confidence").alias("level"))


DOCUMENTS_SQL = "cand AS (SELECT doc_id % 97 AS image, doc_id AS ordinal, 'en' AS mode, least(n_chars / 5000, 1.0)::DOUBLE AS confidence, 3 AS detections, text FROM documents)"


@query(f"""WITH {SCORED.replace(CANDIDATES_SQL, DOCUMENTS_SQL)}, b AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY image ORDER BY usable DESC, (trim(text) <> '') DESC, score DESC, ordinal) = 1),
s AS (SELECT *, {TA} AS ta, {VALID} AS valid, round(least(greatest(0.40 * confidence + 0.20 * (1 - {TA}) + 0.20 * {VALID} + 0.10 * least(length(trim(text)) / 50, 1.0) + 0.10 * (0.6 * confidence + 0.4 * 0.1), 0.0), 1.0), 4) AS reliability FROM b)
SELECT image, ordinal AS doc_id, usable, score, reliability, CASE WHEN trim(text) = '' THEN 'OCR_FAILED' WHEN length(trim(text)) < 3 THEN 'PARTIAL' WHEN ta = 0 AND valid < 0.10 THEN 'LANGUAGE_UNCERTAIN' WHEN reliability < 0.45 THEN 'LOW_CONFIDENCE' ELSE 'SUCCESS' END AS status FROM s""")
def q4_q5_q6_selection(t):
    rows = t("documents").withColumns({"image": F.col("doc_id") % F.lit(97), "conf": F.least(F.col("n_chars") / 5000, F.lit(1.0)), "mode": F.lit("en"), "detections": F.lit(3)})
    best = recognition.best_candidate(rows, "image", "text", "conf", "mode", "detections", "doc_id").withColumn("regions", F.array("conf"))
    best = best.withColumn("reliability", recognition.reliability("text", "conf", "regions", "mode"))
    return best.select("image", "doc_id", "usable", "score", "reliability", recognition.status("text", F.col("reliability")).alias("status"))


@query(f"WITH {CANDIDATES_SQL}, l AS (SELECT image, round(detections * 7 / 15) AS line, ordinal % 50 AS x, text FROM cand), d AS (SELECT image, text, min((line, x, text)) AS k FROM l GROUP BY image, text) SELECT image, string_agg(text, '|' ORDER BY k) AS lines FROM d GROUP BY image")
def o6_lines_in_order(t):
    rows = candidates(t).withColumns({"x": F.col("ordinal") % 50, "y": F.col("detections") * 7})
    return recognition.reading_order(rows, "image", "x", "y", "text").select("image", F.array_join("lines", "|").alias("lines"))


@query(r"""WITH x AS (SELECT c_custkey AS id, 'தமிழ் ab' || c_name AS r, CASE c_custkey % 4 WHEN 0 THEN 'தமழ் ab' ELSE 'தaிழ் தb' END || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || 'தா' END AS h FROM customer),
g AS (SELECT id, r, h, unnest(range(greatest(length(r), length(h)))) AS place FROM x),
k AS (SELECT id, place::INTEGER AS place, nullif(array_to_string(list_slice(regexp_extract_all(r, '(?s).'), place + 1, place + 1), ''), '') AS expected, nullif(array_to_string(list_slice(regexp_extract_all(h, '(?s).'), place + 1, place + 1), ''), '') AS found FROM g)
SELECT id, place, expected, found, CASE WHEN found IS NULL THEN 'deletion' WHEN expected IS NULL THEN 'insertion' WHEN regexp_matches(expected, '[\x{0B80}-\x{0BFF}]') AND regexp_matches(found, '[\x{0B80}-\x{0BFF}]') THEN CASE WHEN regexp_matches(expected || found, '\p{Mn}') THEN 'vowel_modifier_error' ELSE 'tamil_substitution' END
 WHEN regexp_matches(found, '^[\x00-\x7F]$') THEN 'tamil_to_latin_confusion' WHEN regexp_matches(expected, '^[\x00-\x7F]$') THEN 'latin_to_tamil_confusion' ELSE 'other_substitution' END AS error
FROM k WHERE expected IS DISTINCT FROM found AND (regexp_matches(coalesce(expected, ''), '[\x{0B80}-\x{0BFF}]') OR regexp_matches(coalesce(found, ''), '[\x{0B80}-\x{0BFF}]'))""")
def e8_character_errors(t):
    h = F.concat(F.when(F.col("c_custkey") % 4 == 0, "தமழ் ab").otherwise("தaிழ் தb"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("தா"))))
    return recognition.character_errors(t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("தமிழ் ab"), "c_name").alias("r"), h.alias("h")), "id", "r", "h").withColumnRenamed("at", "place")


# Evaluation

GUESSED = "x AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'no' WHEN l_returnflag = 'A' THEN 'yes' ELSE 'maybe' END AS t, CASE WHEN l_quantity > 30 THEN 'no' WHEN l_discount > 0.05 THEN 'yes' ELSE 'maybe' END AS p FROM lineitem)"


def guessed(t):  # noqa: ANN001, ANN201
    return t("lineitem").selectExpr("CASE WHEN l_returnflag = 'N' THEN 'no' WHEN l_returnflag = 'A' THEN 'yes' ELSE 'maybe' END AS t", "CASE WHEN l_quantity > 30 THEN 'no' WHEN l_discount > 0.05 THEN 'yes' ELSE 'maybe' END AS p", "l_quantity", "l_discount", "l_tax")


@query(f"WITH {GUESSED}, c AS (SELECT DISTINCT t AS k FROM x UNION SELECT DISTINCT p FROM x) SELECT a.k AS truth, b.k AS predicted, (SELECT count(*) FROM x WHERE t = a.k AND p = b.k) AS n FROM c a, c b")
def e1_confusion(t):
    return metrics.confusion(guessed(t), "t", "p")


@query(f"""WITH {GUESSED}, c AS (SELECT DISTINCT t AS k FROM x UNION SELECT DISTINCT p FROM x),
m AS (SELECT k, (SELECT count(*) FROM x WHERE t = k) AS support, (SELECT count(*) FROM x WHERE p = k) AS called, (SELECT count(*) FROM x WHERE t = k AND p = k) AS hit FROM c),
r AS (SELECT support, hit / greatest(called, 1) AS p, hit / greatest(support, 1) AS r FROM m), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM r)
SELECT round((SELECT count(*) FILTER (t = p) / count(*) FROM x), 8) AS accuracy, round(avg(p), 8) AS macro_precision, round(avg(r), 8) AS macro_recall, round(avg(f), 8) AS macro_f1, round(sum(p * support) / sum(support), 8) AS weighted_precision, round(sum(r * support) / sum(support), 8) AS weighted_recall, round(sum(f * support) / sum(support), 8) AS weighted_f1 FROM f""")
def e1_summary(t):
    out = metrics.summary(guessed(t), "t", "p")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


def _auc_sql(name: str, score: str) -> str:
    return f"(WITH g AS (SELECT {score} AS s, count(*) FILTER (l_returnflag = '{name}') AS p, count(*) FILTER (l_returnflag <> '{name}') AS n FROM lineitem GROUP BY s), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) FROM b)"


@query(f"SELECT round(({_auc_sql('N', 'l_quantity')} + {_auc_sql('A', 'l_discount')} + {_auc_sql('R', 'l_tax')}) / 3, 8) AS macro_auc")
def e2_one_vs_rest_auc(t):
    rows = t("lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    return metrics.one_vs_rest_auc(rows, "l_returnflag", {"N": "l_quantity", "A": "l_discount", "R": "l_tax"}).select(F.round("macro_auc", 8).alias("macro_auc"))


@query("WITH g AS (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'A') AS p, count(*) AS n FROM lineitem GROUP BY s), c AS (SELECT *, sum(p) OVER w AS hits, sum(n) OVER w AS called FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * hits / called) / sum(p), 8) AS average_precision FROM c")
def e2_average_precision(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("y"), "l_extendedprice")
    return metrics.average_precision(rows, "y", "l_extendedprice").select(F.round("average_precision", 8).alias("average_precision"))


@query("""WITH x AS (SELECT user_id, event_type = 'click' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
q AS (SELECT user_id, count(*) FILTER (hit) AS rel, coalesce(sum(1 / log2(k + 1)) FILTER (hit AND k <= 10), 0) AS dcg FROM x GROUP BY user_id), i AS (SELECT *, (SELECT sum(1 / log2(j + 1)) FROM range(1, 11) r(j) WHERE j <= greatest(rel, 1)) AS ideal FROM q)
SELECT round(avg(CASE WHEN rel > 0 THEN dcg / ideal ELSE 0 END), 8) AS ndcg_10 FROM i""")
def e3_o7_ndcg(t):
    from pyspark.sql import Window

    rows = t("events").select("user_id", (F.col("event_type") == "click").alias("hit"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("k"))
    return metrics.ranking(rows, "user_id", "k", "hit").select(F.round("ndcg_10", 8).alias("ndcg_10"))


@query("WITH x AS (SELECT ltrim(substr(c_name, 10), '0') AS r, (c_custkey * 7)::VARCHAR AS h FROM customer) SELECT round(sum(levenshtein(r, h)) / sum(length(r)), 8) AS wer FROM x")
def e6_y4_word_error_rate(t):
    spaced = lambda c: F.trim(F.regexp_replace(c, "(.)", "$1 "))  # noqa: E731  words of one letter: their errors are those of characters
    rows = t("customer").select(spaced(F.ltrim(F.substring("c_name", 10, 20), F.lit("0"))).alias("r"), spaced((F.col("c_custkey") * 7).cast("string")).alias("h"))
    return metrics.word_error_rate(rows, "r", "h").select(F.round("wer", 8).alias("wer"))


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS truth, CASE WHEN p_partkey % 3 = 0 THEN ' ' || replace(p_name, ' ', '   ') ELSE p_brand || ' ' || split_part(p_name, ' ', 2) END AS guess FROM part),
c AS (SELECT id, truth AS r, trim(regexp_replace(guess, '\\s+', ' ', 'g')) AS p FROM x)
SELECT id, round(levenshtein(r, p) / length(r), 8) AS cer, round(CASE WHEN r IS NULL THEN NULL ELSE ((split_part(r, ' ', 1) <> split_part(p, ' ', 1))::INT + (split_part(r, ' ', 2) <> split_part(p, ' ', 2))::INT) / 2 END, 8) AS wer, (r = p)::INTEGER AS exact_match, CASE WHEN r IS NULL THEN 'MISSING' ELSE 'VALID' END AS annotation_status FROM c""")
def e7_sample_metrics(t):
    truth = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    guess = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "   "))).otherwise(F.concat_ws(" ", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2))))
    out = metrics.sample_metrics(t("part").select(F.col("p_partkey").alias("id"), truth.alias("truth"), guess.alias("guess")), "truth", "guess", ["id"])
    return out.select("id", F.round("cer", 8).alias("cer"), F.round("wer", 8).alias("wer"), "exact_match", "annotation_status")


@query("WITH b AS (SELECT floor(l_discount * 100) AS k, avg(l_tax) AS m FROM lineitem GROUP BY k), l AS (SELECT *, lag(m) OVER (ORDER BY k) AS last FROM b) SELECT CASE WHEN count(*) >= 3 THEN count(*) FILTER (last >= m) / (count(*) - 1) END AS monotone_fraction FROM l")
def w10_monotone_share(t):
    return metrics.monotone_share(t("lineitem").withColumn("k", F.floor(F.col("l_discount") * 100)), "k", "l_tax")


@query("SELECT round(count(*) FILTER (n_chars >= 1500 AND toxic = 0) / count(*) FILTER (toxic = 0), 8) AS false_accept_rate, round(count(*) FILTER (n_chars < 1500 AND toxic = 0) / count(*) FILTER (toxic = 0), 8) AS correct_reject_rate FROM documents JOIN labels USING (doc_id)")
def e10_reject_rates(t):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("good", F.col("toxic") == 1)
    out = recognition.signal_evaluation(rows, "n_chars", "good", 1500)
    return out.select(F.round("false_accept_rate", 8).alias("false_accept_rate"), F.round("correct_reject_rate", 8).alias("correct_reject_rate"))


@query(f"WITH {POSTS_SQL}, c AS (SELECT risk, count(*) AS n FROM posts WHERE split = 'train' AND risk IS NOT NULL GROUP BY risk) SELECT risk AS class, n / (SELECT sum(n) FROM c) AS prior, risk = (SELECT arg_min(risk, (-n, risk)) FROM c) AS majority FROM c")
def m1_majority_class(t):
    return metrics.majority(posts(t).filter("split = 'train' AND risk IS NOT NULL"), "risk")
