"""Queries of scripts and languages, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import languages
from .lineage import spread
from .registry import query

TEXT = "CASE o_orderkey % 12 WHEN 0 THEN 'naan oru velai theduren, pay 500' WHEN 1 THEN 'hai mera kya @naan #oru job' WHEN 2 THEN 'तुम work नहीं' WHEN 3 THEN 'தமிழ் job offer' WHEN 4 THEN '@naan #oru http://naan.oru/nee hello world' WHEN 5 THEN '12 34 ५' WHEN 6 THEN '' WHEN 7 THEN 'apply for the job, ready to pay' WHEN 8 THEN 'مرحبا hello' WHEN 9 THEN 'Ünïcode wörter ñ' WHEN 10 THEN 'naan romba happy hello you' ELSE 'привет the job' END"
TEXTS = f"x AS (SELECT o_orderkey AS id, {TEXT} AS text FROM orders)"
EN = "a an and apply are but can congratulations every for from good hello is job month offer pay ready registration selected the this to work with you"
TA = "naan oru nee unga ungal irukku iruken pannunga pannanum venum illa romba nalla inga anga indha theduren panna velai kidaikkum kudunga"
HI = "hai hain mera meri aap apka kya nahi karna chahiye paisa paise milega accha kaam yeh woh"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
_n = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
TAMIL = r"\x{0B83}\x{0B85}-\x{0BB9}\x{0BD0}"  # letters of the script, without marks
DEVANAGARI = r"\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097F}"
TOKENS = rf"""{TEXTS},
k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(text, '(?i)https?://\S+|www\.\S+', ' ', 'g')), '[@#][\p{{L}}\p{{N}}_]+', ' ', 'g'), '[\p{{L}}\p{{N}}_]+(?:''+[\p{{L}}\p{{N}}_]+)*'), lambda w: NOT regexp_full_match(w, '\p{{N}}+'))) AS w,
  {_n('A-Za-zªµºÀ-ÖØ-öø-ɏ')} AS la, {_n(TAMIL)} AS t, {_n(DEVANAGARI)} AS d, {_n('ء-ي')} AS ar, {_n('а-я')} AS other FROM x),
g AS (SELECT *, len(list_filter(w, lambda c: list_contains({_list(EN)}, c))) AS en, len(list_filter(w, lambda c: regexp_matches(c, '[\x{{0B80}}-\x{{0BFF}}]') OR list_contains({_list(TA)}, c))) AS ta, len(list_filter(w, lambda c: NOT regexp_matches(c, '[\x{{0B80}}-\x{{0BFF}}]') AND (regexp_matches(c, '[\x{{0900}}-\x{{097F}}]') OR list_contains({_list(HI)}, c)))) AS hi FROM k),
s AS (SELECT *, (la > 0)::INT + (t > 0)::INT + (d > 0)::INT + (ar > 0)::INT AS scripts, (t > 0)::INT + (d > 0)::INT + (la > 0 OR ar > 0 OR other > 0)::INT AS by_script, (en > 0)::INT + (ta > 0)::INT + (hi > 0)::INT AS langs FROM g),
m AS (SELECT *, langs >= 2 OR (scripts >= 2 AND by_script >= 2) AS mixed, CASE WHEN t + d + ar = 0 AND ta + hi > 0 THEN CASE WHEN ta >= hi THEN 'ta' ELSE 'hi' END END AS latin_language FROM s)"""


def texts(t):  # noqa: ANN001, ANN201
    return t("orders").selectExpr("o_orderkey AS id", f"{TEXT} AS text").withColumns({"tokens": T.language_tokens("text"), "scripts": T.script_counts("text")})


@query(rf"WITH {TOKENS} SELECT id, en, ta, hi, mixed, CASE WHEN mixed THEN round(least(0.95, 0.6 + 0.1 * least(en + ta + hi, 3)), 4) ELSE 0.0 END::DOUBLE AS mix_confidence, latin_language, CASE WHEN latin_language IS NOT NULL THEN round(least(0.95, 0.65 + 0.08 * least(greatest(ta, hi), 3)), 4) END::DOUBLE AS latin_confidence FROM m")
def l3_l4_l5_mixed_texts(t):
    tokens, scripts = F.col("tokens"), F.col("scripts")
    rows = texts(t).withColumns({"mix": T.code_mix(tokens, scripts), "latin": T.transliteration(tokens, scripts)})
    return rows.select("id", *(F.size(tokens[k]).cast("long").alias(k) for k in ("en", "ta", "hi")), "mix.mixed", F.col("mix.confidence").alias("mix_confidence"), F.col("latin.language").alias("latin_language"), F.col("latin.confidence").alias("latin_confidence"))


@query(rf"WITH {TOKENS.replace(TEXTS, 'x AS (SELECT doc_id AS id, text FROM documents)')} SELECT id AS doc_id, en::INTEGER AS en, ta::INTEGER AS ta, hi::INTEGER AS hi, mixed, CASE WHEN mixed THEN round(least(0.95, 0.6 + 0.1 * least(en + ta + hi, 3)), 4) ELSE 0.0 END::DOUBLE AS mix_confidence, latin_language, CASE WHEN latin_language IS NOT NULL THEN round(least(0.95, 0.65 + 0.08 * least(greatest(ta, hi), 3)), 4) END::DOUBLE AS latin_confidence FROM m")
def l3_l4_l5_code_mix(t):
    found = F.struct(T.language_tokens("text").alias("tokens"), T.script_counts("text").alias("scripts"))
    rows = spread(t("documents").select("doc_id", "text")).select("doc_id", F.inline(F.array(found)))  # generated, so worked out once
    tokens, scripts = F.col("tokens"), F.col("scripts")
    rows = rows.select("doc_id", *(F.size(tokens[k]).alias(k) for k in ("en", "ta", "hi")), T.code_mix(tokens, scripts).alias("mix"), T.transliteration(tokens, scripts).alias("latin"))
    return rows.select("doc_id", "en", "ta", "hi", "mix.mixed", F.col("mix.confidence").alias("mix_confidence"), F.col("latin.language").alias("latin_language"), F.col("latin.confidence").alias("latin_confidence"))


@query(rf"WITH {TOKENS}, a AS (SELECT *, la + t + d + ar + other AS n FROM k) SELECT id, " + ", ".join(f"CASE WHEN n > 0 THEN round({c} / n, 4) ELSE 0.0 END AS {name}" for c, name in (("la", "latin"), ("t", "tamil"), ("d", "devanagari"), ("ar", "arabic"), ("other", "unknown"))) + " FROM a")
def l1_script_shares(t):
    return texts(t).withColumn("s", T.script_shares(F.col("scripts"))).select("id", *(F.col(f"s.{c}").alias(c.lower()) for c in ("Latin", "Tamil", "Devanagari", "Arabic", "Unknown")))


@query(rf"""WITH {TOKENS}, l AS (SELECT *, CASE WHEN langs < 2 AND scripts >= 2 THEN list_distinct(list_filter([CASE WHEN la > 0 OR ar > 0 OR other > 0 THEN 'en' END, CASE WHEN t > 0 THEN 'ta' END, CASE WHEN d > 0 THEN 'hi' END], lambda x: x IS NOT NULL)) ELSE list_filter([CASE WHEN en > 0 THEN 'en' END, CASE WHEN ta > 0 THEN 'ta' END, CASE WHEN hi > 0 THEN 'hi' END], lambda x: x IS NOT NULL) END AS ls FROM m),
p AS (SELECT *, coalesce(latin_language, CASE WHEN t > 0 THEN 'ta' WHEN d > 0 THEN 'hi' WHEN id % 3 = 0 THEN 'fr' ELSE 'en' END) AS p0, mixed OR (la > 0 AND (t > 0 OR d > 0)) AS blend FROM l),
q AS (SELECT *, CASE WHEN p0 = 'en' AND list_contains(ls, 'ta') THEN 'ta' ELSE p0 END AS lang FROM p), r AS (SELECT *, list_filter(ls, lambda x: x <> lang) AS sec FROM q)
SELECT id, CASE WHEN trim(text) = '' THEN 'unknown' ELSE lang END AS language, CASE WHEN trim(text) = '' THEN 0.0 WHEN lang IN ('ta', 'hi') THEN 0.99 ELSE 0.7 END::DOUBLE AS confidence, trim(text) <> '' AND blend AS mixed,
 CASE WHEN trim(text) = '' THEN '' ELSE array_to_string(list_sort(CASE WHEN blend AND lang <> 'en' AND NOT list_contains(sec, 'en') AND la > 0 THEN list_append(sec, 'en') ELSE sec END), ',') END AS secondary FROM r""")
def l7_language_decision(t):
    detected = F.when(F.col("id") % 3 == 0, "fr").otherwise("en")
    rows = texts(t).withColumn("x", T.language_decision("text", F.col("tokens"), F.col("scripts"), detected, F.lit(0.7)))
    return rows.select("id", "x.language", "x.confidence", "x.mixed", F.array_join(F.array_sort("x.secondary"), ",").alias("secondary"))


_GRAMS = r"CASE WHEN length({0}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substring({0}, i, 3))) END"
_BARE = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT lang AS language, {_BARE} AS b FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL), n AS (SELECT language, count(*) AS n FROM d GROUP BY language),
c AS (SELECT language, gram, count(*) AS df FROM (SELECT language, unnest({_GRAMS.format('b')}) AS gram FROM d) GROUP BY language, gram),
v AS (SELECT DISTINCT gram FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY df DESC, gram) <= 300)),
w AS (SELECT v.gram, n.language, ln(greatest(coalesce(c.df / n.n, 0.0), 0.001)) AS weight FROM v CROSS JOIN n LEFT JOIN c ON c.gram = v.gram AND c.language = n.language),
t AS (SELECT item_id AS id, unnest({_GRAMS.format('b')}) AS gram FROM (SELECT item_id, {_BARE} AS b FROM benchmark)),
s AS (SELECT id, language, sum(weight) AS score FROM t JOIN w USING (gram) GROUP BY id, language)
SELECT id, arg_min(language, (-score, language)) AS language, round(1 / sum(exp(score - best)), 4) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM s) GROUP BY id""")
def l6_y2_detected_languages(t):
    """Languages of the benchmark's items by profiles of the documents."""
    return languages.detect(t("benchmark"), "item_id", "text", languages.profiles(t("documents"), "text", "lang"))
