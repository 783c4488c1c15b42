"""Queries of the retrieval set over derived claims and evidence, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, relational, retrieval, search
from .lineage import cut
from .registry import query
from .social import TOPICS_SQL, findings, topics

HANDLE = r"(?i)\+91|@okhdfc|@okaxis|@paytm|portal-|\.org|\.com|\.net|\.top"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\S+', '', 'g'), '[\r\n\t]+', ' ', 'g'), '\s+', ' ', 'g'))"


def search_text(c: str) -> str:
    clean = CLEAN.format(c)
    return f"CASE WHEN len(string_split({clean}, ' ')) <= 8 THEN {clean} ELSE coalesce(nullif(array_to_string(list_filter(string_split({clean}, ' '), lambda w: NOT regexp_matches(w, '{HANDLE}'))[1:10], ' '), ''), {clean}) END"


SET = rf"""{TOPICS_SQL},
words AS (SELECT claim_id, ordinal, claim_type, language, split, campaign, source_group, {search_text('claim_text')} AS query_text FROM claims),
firsts AS (SELECT * FROM evidence WHERE trim(evidence_text) <> '' AND relation IN ('SUPPORTS', 'CONTRADICTS') QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY evidence_id) = 1),
pool AS (SELECT e.*, coalesce(c.split, 'train') AS split FROM evidence e LEFT JOIN claims c USING (claim_id)),
asked AS (SELECT w.claim_id, coalesce(split, 'train') AS split, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2)) AS q FROM words w),
offered AS (SELECT evidence_id, claim_id AS own, relation, evidence_text, split, list_distinct(list_filter(regexp_extract_all(lower(evidence_text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2)) AS w FROM pool WHERE relation NOT IN ('SUPPORTS', 'CONTRADICTS')),
scored AS (
  SELECT a.claim_id, evidence_id, evidence_text, relation, CASE WHEN own = a.claim_id THEN 3 WHEN relation = 'NEUTRAL' THEN 2 ELSE 1 END AS priority,
    CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0.0 ELSE round(len(list_intersect(q, w)) / (len(q) + len(w) - len(list_intersect(q, w))), 4) END AS similarity FROM asked a JOIN offered o USING (split)),
once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY claim_id, evidence_text ORDER BY similarity DESC, priority DESC, evidence_id DESC) = 1),
negatives AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, priority DESC, evidence_id DESC) AS rank, ['CROSS_ENTITY_NEGATIVE', 'HARD_TOPIC_NEGATIVE', 'HARD_ENTITY_NEGATIVE'][priority] AS negative_type FROM once QUALIFY rank <= 3),
examples AS (
  SELECT w.claim_id, row_number() OVER (ORDER BY w.ordinal) AS num, query_text, CASE WHEN upper(claim_type) IN ('FINANCIAL', 'INVESTMENT') THEN 'FINANCIAL' WHEN upper(claim_type) = 'TEMPORAL' THEN 'TEMPORAL' ELSE 'VERIFICATION' END AS query_type,
    f.evidence_id AS positive_id, f.evidence_text AS positive_text, f.relation AS positive_relation, coalesce(w.language, 'en') AS query_language, coalesce(f.language, 'en') AS evidence_language, coalesce(w.split, 'train') AS split,
    CASE WHEN campaign IS NOT NULL THEN 'camp_' || campaign WHEN source_group IS NOT NULL THEN 'src_' || source_group ELSE 'claim_cluster_' || w.claim_id END AS cluster_id
  FROM words w JOIN firsts f USING (claim_id) WHERE w.claim_id IN (SELECT claim_id FROM negatives)),
pairs AS (
  SELECT printf('pair_%06d_pos', num) AS pair_id, 'q_' || claim_id || '_01' AS query_id, positive_id AS evidence_id, positive_text AS document_text, 1 AS label, positive_relation AS relation, NULL AS negative_type, split FROM examples
  UNION ALL SELECT printf('pair_%06d_neg_', num) || rank, 'q_' || claim_id || '_01', n.evidence_id, n.evidence_text, 0, n.relation, n.negative_type, e.split FROM examples e JOIN negatives n USING (claim_id))"""


def claims(t):  # noqa: ANN001, ANN201
    none = F.lit(None).cast("string")
    return topics(t).withColumn("translation", none).withColumn("cluster_id", quality.cluster_id("campaign", "translation", "source_group", "claim_id"))


def examples(t):  # noqa: ANN001, ANN201
    return retrieval.examples(claims(t), findings(t), "ordinal")


@query(f"WITH {SET} SELECT claim_id, query_text FROM words")
def r1_o8_search_text(t):
    return claims(t).select("claim_id", T.search_text("claim_text").alias("query_text"))


@query(f"""WITH {SET}, v AS (SELECT claim_id, 1 AS variant, query_text, CASE WHEN upper(claim_type) IN ('FINANCIAL', 'INVESTMENT') THEN 'FINANCIAL' WHEN upper(claim_type) = 'TEMPORAL' THEN 'TEMPORAL' ELSE 'VERIFICATION' END AS query_type FROM words
 UNION ALL SELECT claim_id, 2, array_to_string(string_split(query_text, ' ')[1:5], ' ') || ' official registration', 'ENTITY' FROM words WHERE len(string_split(query_text, ' ')) >= 4)
SELECT claim_id, variant, printf('q_%s_%02d', claim_id, variant) AS query_id, query_text, query_type FROM v""")
def r2_query_variants(t):
    return retrieval.query_variants(claims(t))


@query(f"WITH {SET} SELECT claim_id, evidence_id, relation FROM firsts")
def w2_p20_first_positive(t):
    return retrieval.positives(findings(t), "evidence_id").select("claim_id", "evidence_id", "relation")


@query(f"WITH {SET} SELECT evidence_id, split FROM pool")
def j6_candidate_pool(t):
    return retrieval.pool(findings(t), claims(t)).select("evidence_id", "split")


@query(f"WITH {SET} SELECT claim_id, evidence_id, relation, negative_type, similarity, rank FROM negatives")
def j7_r3_r4_r5_o1_hard_negatives(t):
    asked = retrieval.query_variants(claims(t)).filter("variant = 1").join(claims(t).select("claim_id", F.coalesce("split", F.lit("train")).alias("split")), "claim_id")
    return retrieval.hard_negatives(asked.select("claim_id", "split", "query_text"), retrieval.pool(findings(t), claims(t))).withColumn("rank", F.col("rank").cast("long")).drop("evidence_text")


@query(f"""WITH {SET} SELECT printf('ret_%06d', num) AS retrieval_id, e.claim_id, e.query_text, query_type, positive_id, positive_relation, n.evidence_id AS negative_id, n.negative_type, query_language, evidence_language, query_language <> evidence_language AS cross_language, split, cluster_id, num % 4 = 0 AS human_reviewed
 FROM examples e JOIN negatives n ON n.claim_id = e.claim_id AND n.rank = 1""")
def r6_w6_w7_examples(t):
    return examples(t).drop("negatives", "query_id", "positive_text")


@query(f"WITH {SET} SELECT * FROM pairs")
def r7_pairs(t):
    return retrieval.pairs(examples(t)).drop("retrieval_id", "query_text", "cluster_id", "cross_language")


@query(f"""WITH {SET} SELECT 'q_' || claim_id || '_01' AS query_id, e.claim_id, positive_id AS relevant, positive_id || ',' || string_agg(n.evidence_id, ',' ORDER BY rank) AS candidates, cluster_id
 FROM examples e JOIN negatives n USING (claim_id) WHERE split = 'test' GROUP BY e.claim_id, positive_id, cluster_id""")
def r8_o7_evaluation_pool(t):
    out = retrieval.evaluation_pool(examples(t))
    return out.select("query_id", "claim_id", F.array_join("relevant_ids", ",").alias("relevant"), F.array_join(F.transform("candidates", lambda c: c["evidence_id"]), ",").alias("candidates"), "cluster_id")


@query(f"""WITH {SET} SELECT (SELECT count(*) FROM examples) AS records, (SELECT count(*) FROM pairs) AS pairs, (SELECT count(DISTINCT claim_id) FROM examples) AS queries, (SELECT count(DISTINCT positive_id) FROM examples) AS positives, (SELECT count(DISTINCT cluster_id) FROM examples) AS clusters,
 (SELECT count(*) FROM pairs WHERE label = 0) AS negatives, (SELECT count(*) FROM examples WHERE query_language <> evidence_language) AS cross_language, (SELECT count(*) FROM examples WHERE num % 4 = 0) AS reviewed,
 (SELECT count(*) FROM examples WHERE split = 'train') AS train, (SELECT count(*) FROM examples WHERE split = 'validation') AS validation, (SELECT count(*) FROM examples WHERE split = 'test') AS test""")
def r9_a7_manifest(t):
    found = examples(t)
    return retrieval.manifest(found, retrieval.pairs(found))


@query(f"WITH {SET} SELECT negative_type, count(*) AS n FROM pairs WHERE label = 0 GROUP BY negative_type")
def a8_negative_types(t):
    return examples(t).select(F.explode("negatives").alias("n")).groupBy(F.col("n.negative_type").alias("negative_type")).agg(F.count("*").alias("n"))


@query(f"WITH {SET}, twice AS (SELECT * FROM pairs UNION ALL SELECT * FROM pairs WHERE label = 1) SELECT sum(n - 1)::BIGINT AS duplicate_pairs FROM (SELECT count(*) AS n FROM twice GROUP BY query_id, evidence_id)")
def a11_u1_duplicate_pairs(t):
    rows = retrieval.pairs(examples(t))
    return retrieval.duplicate_pairs(rows.unionByName(rows.filter("label = 1")))  # every positive once more


@query(f"""WITH {TOPICS_SQL}, v AS (SELECT 'claim_id' AS key, claim_id AS x, ordinal FROM claims UNION ALL SELECT 'source_group', source_group, ordinal FROM claims UNION ALL SELECT 'claim_text', claim_text, ordinal FROM claims),
n AS (SELECT key, x, bool_or(ordinal % 3 <> 0) AS old, bool_or(ordinal % 5 <> 0) AS new FROM v WHERE x IS NOT NULL GROUP BY key, x)
SELECT key, count(*) FILTER (old) AS old_exact, count(*) FILTER (new) AS new_exact, true AS old_near, true AS new_near, true AS together_near, true AS added_near FROM n GROUP BY key""")
def a7_r9_version_sketches(t):
    """Distinct values of two versions of a set, from sketches kept in a table: within four standard errors of the exact counts, in union and difference too."""
    rows = claims(t)
    keys = ["claim_id", "source_group", "claim_text"]
    old, new = rows.filter("ordinal % 3 <> 0"), rows.filter("ordinal % 5 <> 0")
    kept = cut(relational.sketched(old, keys, "v1").unionByName(relational.sketched(new, keys, "v2")))
    exact = [rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.bool_or(F.expr("ordinal % 3 <> 0")).alias("o"), F.bool_or(F.expr("ordinal % 5 <> 0")).alias("n")).agg(F.count_if("o").alias("old_exact"), F.count_if("n").alias("new_exact"), F.count_if(F.col("o") | F.col("n")).alias("all"), F.count_if(F.col("n") & ~F.col("o")).alias("more")).withColumn("key", F.lit(k)) for k in keys]
    both = relational.compared_versions(kept, "v1", "v2").join(exact[0].unionByName(exact[1]).unionByName(exact[2]), "key")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 / 2**6 * F.col("all")
    return both.select("key", "old_exact", "new_exact", near("old", "old_exact").alias("old_near"), near("new", "new_exact").alias("new_near"), near("together", "all").alias("together_near"), near("added", "more").alias("added_near"))


DENSE = """nearest AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM q JOIN d ON q.id <> d.id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM nearest)"""


@query(f"""WITH d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT * FROM d WHERE id % 20 = 0), {DENSE}
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM dense WHERE rank <= 10""")
def r10_dense_search(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.dense(rows, rows.filter("id % 20 = 0"), own=False)


SPLIT = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
q AS (SELECT id, v, {search_text('text')} AS asked FROM d WHERE id % 20 = 0), {DENSE},
w AS (SELECT id, {SPLIT.format("coalesce(text, '')")} AS w FROM d), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
p AS (SELECT id, len(w) AS l, unnest(w) AS word FROM w), f AS (SELECT id, l, word, count(*) AS tf FROM p GROUP BY ALL),
i AS (SELECT word, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, n GROUP BY word),
x AS (SELECT DISTINCT id AS query_id, unnest({SPLIT.format('asked')}) AS word FROM q),
b AS (SELECT query_id, id AS doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM x JOIN f USING (word) JOIN i USING (word), n WHERE query_id <> id GROUP BY query_id, id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b),
both_ AS (SELECT query_id, doc_id, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM dense WHERE rank <= 50),
s AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM both_ GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 10""")
def r10_hybrid_search(t):
    """Documents by the search text made of each twentieth and by its vector."""
    rows = cut(t("documents").select(F.col("doc_id").alias("id"), "text").join(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id"))  # read several times
    return search.hybrid(rows, rows.filter("id % 20 = 0").withColumn("text", T.search_text("text")))
