"""The tabular feature matrix: grouped aggregates of a post's claims, evidence, images, sources and graph.

Each group of features is one aggregation by post; ``matrix`` joins them to the posts and puts the columns in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

RELATIONS = ["SUPPORTS", "CONTRADICTS", "NEUTRAL", "INSUFFICIENT"]

def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)


#: Parts of texts, sought anywhere in the lower-cased text (``SYMBOLS`` in the text as it is).
GUARANTEES = ["guarantee", "guaranteed", "100%", "zero risk", "urudhi", "pakka", "sure shot"]
SYMBOLS = ["₹", "$", "Rs", "INR", "USD"]
DEADLINES = ["daily", "weekly", "monthly", "hour", "deadline", "today"]
CONDITIONS = ["if", "deposit", "min", "invest"]
NEGATIONS = ["not", "no", "never", "illai", "nahi"]
PERIODS = ["weekly", "monthly", "daily", "days", "hours"]
URGENCY = ["urgent", "today only", "hurry", "limited", "fast", "now", "quick"]
UPFRONT = ["fee", "deposit", "advance", "registration", "processing", "upfront", "pay first"]
#: Hosts that are official or shorten links, types of sources that are official.
OFFICIAL_HOSTS = [".gov", "gov.in", "official.gov", "sebi.gov.in", "rbi.org.in", "cert-in.org.in"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.me", "is.gd", "buff.ly", "ow.ly", "goo.gl"]
OFFICIAL_TYPES = ["REGULATORY_ALERT", "PUBLIC_DATASET", "FACT_CHECKING"]
#: Language indexes.
LANGUAGES = {"en": 0, "ta": 1, "hi": 2, "ta-en": 3, "hi-en": 4}
#: Two codings of the label.
LABELS = {"INSUFFICIENT": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
BINARY = {"INSUFFICIENT": 0, "LOW": 0, "MEDIUM": 1, "HIGH": 1}
#: The features by group, in their order.
GROUPS = {
    "TEXT": "text_length word_count sentence_count uppercase_ratio digit_ratio punctuation_ratio url_count_in_text phone_count email_count currency_symbol_count exclamation_count question_count",
    "LANGUAGE": "language language_id script is_code_mixed is_transliterated language_confidence",
    "CLAIM": "claim_count atomic_claim_count verifiable_claim_count non_verifiable_claim_count claim_decomposition_confidence has_financial_claim has_job_claim has_giveaway_claim has_credential_claim has_shopping_claim conditional_claim_count negated_claim_count numeric_claim_count temporal_claim_count",
    "EVIDENCE": "evidence_count has_evidence claims_with_evidence claims_without_evidence evidence_coverage_ratio evidence_source_count independent_source_count source_diversity",
    "RETRIEVAL": "retrieved_evidence_count relevant_evidence_count supporting_retrieval_count contradicting_retrieval_count top_retrieval_score retrieval_score_available",
    "CONTRADICTION": "support_count contradict_count neutral_count insufficient_count support_ratio contradiction_ratio neutral_ratio insufficient_ratio support_to_contradiction_ratio contradiction_presence support_presence evidence_relation_entropy",
    "IMAGE": "image_count has_image ocr_available ocr_confidence ocr_text_length image_reuse_count phash_match_count ocr_unreliable",
    "SOURCE_DOMAIN": "source_count unique_source_count official_source_present domain_count unique_domain_count official_domain_match domain_age_days domain_age_available shortened_url_count",
    "GRAPH": "graph_node_count graph_edge_count graph_claim_nodes graph_evidence_nodes graph_url_nodes graph_account_nodes graph_support_edges graph_contradict_edges graph_neutral_edges graph_insufficient_edges graph_degree_mean",
    "SCAM_SIGNAL": "guarantee_claim_present urgency_signal_present upfront_payment_present financial_claim_count currency_present temporal_deadline_present",
}
FEATURES = [name for names in GROUPS.values() for name in names.split()]
GROUP_OF = {name: group for group, names in GROUPS.items() for name in names.split()}
CATEGORICAL = ["language", "script"]
#: Features of which a negative value stands for none.
SENTINELS = ["domain_age_days", "top_retrieval_score", "mean_retrieval_score", "max_retrieval_score", "ocr_confidence"]
#: What a post has where it has no rows of a group; other features have 0 or false.
DEFAULTS = {"top_retrieval_score": -1.0, "ocr_confidence": -1.0, "domain_age_days": -1.0}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts stands anywhere in a text."""
    out = F.lit(False)
    for part in parts:
        out |= F.coalesce(text.contains(part), F.lit(False))
    return out


def _mapped(c: Column, of: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), c)


def language_features(posts: DataFrame) -> DataFrame:
    """Of posts with ``language, script, code_mixed, transliterated``, which may be null."""
    language = F.lower(F.coalesce("language", F.lit("en")))
    mixed = F.coalesce("code_mixed", F.lit(False)) | language.contains("-en")
    return posts.select("post_id", language.alias("language"), F.coalesce(_mapped(language, LANGUAGES), F.lit(0)).alias("language_id"), F.coalesce("script", F.lit("Latin")).alias("script"), mixed.alias("is_code_mixed"), F.coalesce("transliterated", F.lit(False)).alias("is_transliterated"), F.lit(1.0).alias("language_confidence"))


def claim_features(claims: DataFrame) -> DataFrame:
    """Counts and flags over a post's claims (``claim_text, claim_type, check_worthiness``), with the signals of scams."""
    kind, raw, worth = F.upper("claim_type"), F.coalesce("claim_text", F.lit("")), F.coalesce("check_worthiness", F.lit(1.0))
    text = F.lower(raw)
    named = {f"has_{k.lower()}_claim": F.bool_or(F.coalesce(kind == k, F.lit(False))) for k in ("FINANCIAL", "JOB", "GIVEAWAY", "CREDENTIAL", "SHOPPING")}
    aggs = {
        "claim_count": F.count("*"), "atomic_claim_count": F.count("*"), "verifiable_claim_count": F.count_if(worth >= 0.5), "non_verifiable_claim_count": F.count_if(worth < 0.5),
        "claim_decomposition_confidence": F.round(F.avg(worth), 4), **named,
        "conditional_claim_count": F.count_if(has_any(text, CONDITIONS)), "negated_claim_count": F.count_if(has_any(text, NEGATIONS)), "numeric_claim_count": F.count_if(raw.rlike("[0-9%]")), "temporal_claim_count": F.count_if(has_any(text, PERIODS)),
        "guarantee_claim_present": F.bool_or(has_any(text, GUARANTEES)), "urgency_signal_present": F.bool_or(has_any(text, URGENCY)), "upfront_payment_present": F.bool_or(has_any(text, UPFRONT)),
        "financial_claim_count": F.count_if(kind == "FINANCIAL"), "currency_present": F.bool_or(has_any(raw, SYMBOLS)), "temporal_deadline_present": F.bool_or(has_any(text, DEADLINES)),
    }
    return claims.groupBy("post_id").agg(*(c.alias(name) for name, c in aggs.items()))


def evidence_features(claims: DataFrame, evidence: DataFrame, of_claims: bool = False) -> DataFrame:
    """Coverage of a post's claims and diversity of its evidence's sources; ``evidence`` has ``post_id, claim_id, source_type, source_url``.

    With ``of_claims`` evidence has the ``post_id`` of its claim, so claims meet it by post, with no exchange by claim.
    """
    host = F.nullif(F.lower(F.regexp_extract("source_url", _HOST, 1)), F.lit(""))
    # a set for each post, as several distinct counts would multiply and exchange all rows
    found = evidence.groupBy("post_id").agg(F.count("*").alias("evidence_count"), *(F.size(F.collect_set(c)).cast("long").alias(name) for name, c in (("types", F.nullif("source_type", F.lit(""))), ("hosts", host))))
    if of_claims:
        both = claims.select("post_id", "claim_id", F.lit(1).alias("n"), F.lit(0).alias("known")).unionByName(evidence.select("post_id", "claim_id", F.lit(0).alias("n"), F.lit(1).alias("known")))
        met = both.groupBy("post_id", "claim_id").agg(F.sum("n").alias("n"), F.max("known").alias("known")).filter("n > 0")
        covered = met.groupBy("post_id").agg(F.sum("n").alias("n_claims"), F.sum(F.when(F.col("claim_id").isNotNull(), F.col("n") * F.col("known")).otherwise(0)).alias("claims_with_evidence"))
    else:
        known = evidence.select("claim_id").distinct().withColumn("known", F.lit(True))
        covered = claims.join(known, "claim_id", "left").groupBy("post_id").agg(F.count("*").alias("n_claims"), F.count("known").alias("claims_with_evidence"))
    some, one = F.col("evidence_count") > 0, F.lit(1)
    out = covered.join(found, "post_id", "full").fillna(0)
    return out.select(
        "post_id", "evidence_count", some.alias("has_evidence"), F.when(some, F.col("claims_with_evidence")).otherwise(0).alias("claims_with_evidence"),
        F.when(some, F.col("n_claims") - F.col("claims_with_evidence")).otherwise(F.col("n_claims")).alias("claims_without_evidence"),
        F.when(some, F.round(F.col("claims_with_evidence") / F.greatest("n_claims", one), 4)).otherwise(0.0).alias("evidence_coverage_ratio"),
        F.when(some, F.greatest("types", one)).otherwise(0).alias("evidence_source_count"), F.when(some, F.greatest("hosts", one)).otherwise(0).alias("independent_source_count"),
        F.when(some, F.round(F.greatest("hosts", one) / F.col("evidence_count"), 4)).otherwise(0.0).alias("source_diversity"),
    )


def retrieval_features(items: DataFrame) -> DataFrame:
    """Of one evaluation item of each post: ``post_id, relevant_ids, candidates`` (as of ``retrieval.evaluation_pool``)."""
    count = lambda of: F.size(F.filter("candidates", of))
    scores = F.array_compact(F.transform("candidates", lambda c: c["similarity"]))
    relevant = count(lambda c: c["is_relevant"] | F.array_contains("relevant_ids", c["evidence_id"]))
    return items.select(
        "post_id", F.size("candidates").alias("retrieved_evidence_count"), relevant.alias("relevant_evidence_count"), count(lambda c: c["relation"] == "SUPPORTS").alias("supporting_retrieval_count"),
        count(lambda c: c["relation"] == "CONTRADICTS").alias("contradicting_retrieval_count"), F.round(F.coalesce(F.array_max(scores), F.lit(-1.0)), 4).alias("top_retrieval_score"), (F.size(scores) > 0).alias("retrieval_score_available"),
    )


def first_items(claims: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """The item of each post's first claim that has one; where ``items`` have the ``post_id`` of their claim, they meet by post, with no exchange by claim."""
    rest = [c for c in items.columns if c not in ("claim_id", "post_id")]
    rows = claims.select("post_id", "claim_id", F.col(order).alias("_order"))
    if "post_id" in items.columns:
        item = F.struct(*rest)
        rows = rows.withColumn("_order", F.when(F.col("claim_id").isNotNull(), F.col("_order")))  # rather than a filter, which would part items from other uses of their rows
        both = rows.withColumn("_item", F.lit(None).cast(items.select(item.alias("x")).schema["x"].dataType)).unionByName(items.select("post_id", "claim_id", item.alias("_item")), allowMissingColumns=True)
        met = both.groupBy("post_id", "claim_id").agg(F.min("_order").alias("_order"), F.first("_item", ignorenulls=True).alias("_item"))
        rows = met.filter("_order is not null and _item is not null").select("post_id", "claim_id", "_order", "_item.*")
    else:
        rows = rows.join(items, "claim_id")
    return rows.groupBy("post_id").agg(F.min_by(F.struct("claim_id", *rest), F.struct("_order", "claim_id")).alias("x")).select("post_id", "x.*")


def contradiction_features(evidence: DataFrame) -> DataFrame:
    """Counts and shares of relations and their entropy over the rounded shares; ``evidence`` has ``post_id, relation``."""
    names = {"support": "SUPPORTS", "contradict": "CONTRADICTS", "neutral": "NEUTRAL", "insufficient": "INSUFFICIENT"}
    ratios = {"support": "support_ratio", "contradict": "contradiction_ratio", "neutral": "neutral_ratio", "insufficient": "insufficient_ratio"}
    out = evidence.groupBy("post_id").agg(F.count("*").alias("_n"), *(F.count_if(F.col("relation") == r).alias(f"{k}_count") for k, r in names.items()))
    out = out.withColumns({ratios[k]: F.round(F.col(f"{k}_count") / F.col("_n"), 4) for k in names})
    entropy = sum((F.when(F.col(r) > 0, -F.col(r) * F.log2(r)).otherwise(0.0) for r in ratios.values()), F.lit(0.0))
    return out.select("post_id", *(f"{k}_count" for k in names), *ratios.values(), F.round(F.col("support_count") / (F.col("contradict_count") + 1), 4).alias("support_to_contradiction_ratio"), (F.col("contradict_count") > 0).alias("contradiction_presence"), (F.col("support_count") > 0).alias("support_presence"), F.round(entropy, 4).alias("evidence_relation_entropy"))


def image_features(images: DataFrame) -> DataFrame:
    """Of the images of posts: ``post_id, ocr_text, ocr_confidence, phash, image_reuse``."""
    read = F.coalesce(F.col("ocr_text") != "", F.lit(False))
    out = images.groupBy("post_id").agg(F.count("*").alias("image_count"), F.bool_or(read).alias("ocr_available"), F.round(F.avg(F.when(read, F.col("ocr_confidence"))), 4).alias("c"), F.sum(F.when(read, F.length("ocr_text")).otherwise(0)).alias("ocr_text_length"), F.count_if("image_reuse").alias("image_reuse_count"), F.count_if(F.coalesce(F.col("phash") != "", F.lit(False))).alias("phash_match_count"))
    conf = F.coalesce("c", F.lit(-1.0))
    return out.select("post_id", "image_count", F.lit(True).alias("has_image"), "ocr_available", conf.alias("ocr_confidence"), "ocr_text_length", "image_reuse_count", "phash_match_count", (F.col("ocr_available") & (conf >= 0) & (conf < 0.5)).alias("ocr_unreliable"))


def source_features(evidence: DataFrame) -> DataFrame:
    """Named sources of a post's evidence, and whether one is official; ``evidence`` has ``post_id, source_type, source_name``."""
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    official = kind.isin(OFFICIAL_TYPES) | kind.contains("REGULATORY") | kind.contains("OFFICIAL")
    n = F.greatest(F.count_distinct(F.nullif("source_name", F.lit(""))), F.lit(1))
    return evidence.groupBy("post_id").agg(n.alias("source_count"), n.alias("unique_source_count"), F.bool_or(official).alias("official_source_present"))


def link_features(posts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hosts of a post's links (``url``, one row for each) and of its evidence; shortened links, also named in the text.  A host's age is not known."""
    host = F.nullif(F.lower(F.regexp_extract("u", _HOST, 1)), F.lit(""))
    links = posts.select("post_id", F.col("url").alias("u")).unionByName(evidence.select("post_id", F.col("source_url").alias("u"))).withColumn("h", host)
    found = links.groupBy("post_id").agg(F.count_distinct("h").alias("n"), F.bool_or(has_any(F.col("h"), OFFICIAL_HOSTS)).alias("official"), F.count_if(has_any(F.col("h"), SHORTENERS)).alias("short"))
    named = sum((F.coalesce(F.lower("text").contains(x), F.lit(False)).cast("long") for x in SHORTENERS), F.lit(0).cast("long"))
    rows = posts.groupBy("post_id").agg(F.max("text").alias("text")).join(found, "post_id", "left")
    return rows.select("post_id", F.coalesce("n", F.lit(0)).alias("domain_count"), F.coalesce("n", F.lit(0)).alias("unique_domain_count"), F.coalesce("official", F.lit(False)).alias("official_domain_match"), F.lit(-1.0).alias("domain_age_days"), F.lit(False).alias("domain_age_available"), (F.coalesce("short", F.lit(0)) + named).alias("shortened_url_count"))


def edge_features(edges: DataFrame) -> DataFrame:
    """Counts by type of each post's edges; posts without edges have no row."""
    kinds = {"support": ["SUPPORTS"], "contradict": ["CONTRADICTS"], "neutral": ["NEUTRAL_TO", "NEUTRAL"], "insufficient": ["INSUFFICIENT_FOR", "INSUFFICIENT"]}
    return _of_posts(edges.groupBy(graph.key(edges)).agg(F.count("*").alias("graph_edge_count"), *(F.count_if(F.col("edge_type").isin(of)).alias(f"graph_{k}_edges") for k, of in kinds.items())))


def graph_features_by_post(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """As ``graph_features``, of ``graph.parts``: all but comments are counted where they lie; comments, which count only in the totals, are counted first."""
    said = [of["comment"].groupBy("post_id").agg(F.count("*").alias(f"_{name}")) for name, of in (("nodes", nodes), ("edges", edges))]
    v, e = graph.whole(nodes, "comment"), graph.whole(edges, "comment")
    out = _node_counts(v).join(edge_features(e), "post_id", "left").join(said[0], "post_id", "left").join(said[1], "post_id", "left").fillna(0)
    return _with_degree(out.withColumns({"graph_node_count": F.col("graph_node_count") + F.col("_nodes"), "graph_edge_count": F.col("graph_edge_count") + F.col("_edges")}).drop("_nodes", "_edges"))


def edge_features_by_post(edges: dict[str, DataFrame]) -> DataFrame:
    """As ``edge_features``, of ``graph.parts``, likewise."""
    said = edges["comment"].groupBy("post_id").agg(F.count("*").alias("_edges"))
    out = edge_features(graph.whole(edges, "comment")).join(said, "post_id", "full").fillna(0)
    return out.withColumn("graph_edge_count", F.col("graph_edge_count") + F.col("_edges")).drop("_edges")


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type and mean degree of each post's graph."""
    return _with_degree(_of_posts(_node_counts(nodes)).join(edge_features(edges), "post_id", "left").fillna(0))


def _node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(graph.key(nodes)).agg(F.count("*").alias("graph_node_count"), *(F.count_if(F.col("node_type") == k).alias(f"graph_{k.lower()}_nodes") for k in ("CLAIM", "EVIDENCE", "URL", "ACCOUNT")))


def _with_degree(out: DataFrame) -> DataFrame:
    return out.withColumn("graph_degree_mean", F.round(2.0 * F.col("graph_edge_count") / F.greatest("graph_node_count", F.lit(1)), 4))


def _of_posts(rows: DataFrame) -> DataFrame:
    """Graphs' rows by the ids of their posts."""
    return rows if "post_id" in rows.columns else rows.select(F.regexp_replace("graph_id", "^graph_", "").alias("post_id"), *(c for c in rows.columns if c != "graph_id"))


def in_order(df: DataFrame, wanted: list[str] = FEATURES) -> DataFrame:
    """The id columns and the wanted features in their order; a post without rows of a group has the group's defaults."""
    types = dict(df.dtypes)
    zero = lambda c: F.lit(DEFAULTS.get(c, False if types[c] == "boolean" else 0))
    return df.select("feature_id", "post_id", "cluster_id", "split", "risk_label", *(F.col(c) if c in CATEGORICAL else F.coalesce(c, zero(c)).alias(c) for c in FEATURES if c in wanted))


def training_matrix(df: DataFrame) -> DataFrame:
    """The matrix with categories as their places among the sorted values, and the label in both codings."""
    out = df
    for c in CATEGORICAL:
        values = df.agg(F.array_sort(F.collect_set(c)).alias(f"_{c}"))  # the few values of a category
        out = out.join(F.broadcast(values)).withColumn(c, F.array_position(f"_{c}", F.col(c)) - 1).drop(f"_{c}")
    return out.withColumns({"label": _mapped(F.col("risk_label"), LABELS), "label_binary": _mapped(F.col("risk_label"), BINARY)})


def undeclared(columns: list[str]) -> list[str]:
    """Columns that are neither ids nor features."""
    return [c for c in columns if c not in ("feature_id", "post_id", "cluster_id", "split", "risk_label") and c not in GROUP_OF]


def validate(df: DataFrame) -> DataFrame:
    """One row: what is wrong with a matrix, as counts and as codes."""
    numbers = [c for c, t in df.dtypes if c in GROUP_OF and t in ("double", "float")]
    spans = lambda key: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"{key}_leakage"))
    one = df.agg(
        F.count("*").alias("total_rows"), *(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")),
        (F.count("feature_id") - F.count_distinct("feature_id")).alias("duplicate_ids"), (F.count("post_id") - F.count_distinct("post_id")).alias("duplicate_rows"),
        F.count_if(~F.coalesce(F.col("risk_label").isin(*LABELS), F.lit(False))).alias("invalid_labels"), F.count_if(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))).alias("invalid_splits"),
        F.sum(sum((F.coalesce(F.abs(c) == float("inf"), F.lit(False)).cast("int") for c in numbers), F.lit(0))).alias("infinite_values"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in FEATURES if c in df.columns), F.lit(0))).alias("null_cells"),
    )
    one = one.join(F.broadcast(spans("post_id"))).join(F.broadcast(spans("cluster_id")))  # one row each
    one = one.withColumns({"missing_columns": F.lit(len([c for c in FEATURES if c not in df.columns])), "undeclared_columns": F.lit(len(undeclared(df.columns))), "leaking_columns": F.lit(len(leaking_columns([c for c in df.columns if c != "risk_label"])))})
    checks = {"DUPLICATE_IDS": "duplicate_ids", "DUPLICATE_ROWS": "duplicate_rows", "INVALID_LABELS": "invalid_labels", "INVALID_SPLITS": "invalid_splits", "INFINITE_VALUES": "infinite_values", "POST_LEAKAGE": "post_id_leakage", "CLUSTER_LEAKAGE": "cluster_id_leakage", "MISSING_COLUMNS": "missing_columns", "UNDECLARED_COLUMNS": "undeclared_columns", "TARGET_LEAKAGE": "leaking_columns"}
    return one.withColumn("errors", F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(k)) for k, c in checks.items()))))


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, NaN, infinite, negative where that stands for none, or a word for none."""
    t = dict(df.dtypes)[c]
    out = F.col(c).isNull()
    if t in ("double", "float"):
        out |= F.isnan(c) | (F.abs(c) == float("inf"))
    if c in SENTINELS:
        out |= F.col(c) < 0
    if t == "string":
        out |= F.col(c).isin("UNKNOWN", "unknown", "NONE", "none")
    return out


def completeness(df: DataFrame) -> DataFrame:
    """``level, name, missing, cells, rate``: of each feature, each group and overall, from one pass over the rows."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(is_missing(df, c)).alias(c) for c in FEATURES))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(GROUP_OF[c]).alias("group"), F.col(c).alias("missing"), "n") for c in FEATURES))).alias("x")).select("x.*")
    out = long.groupingSets([[F.col("feature")], [F.col("group")], []], "feature", "group").agg(F.sum("missing").alias("missing"), F.sum("n").alias("cells"), F.grouping_id().alias("g"))
    level = F.when(F.col("feature").isNotNull(), "feature").when(F.col("group").isNotNull(), "group").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("feature", "group", F.lit("all")).alias("name"), "missing", "cells", F.round(F.coalesce(F.try_divide("missing", "cells"), F.lit(0.0)), 4).alias("rate"))


def excessive_rows(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows with more than this share of their features missing."""
    n = sum((F.coalesce(is_missing(df, c), F.lit(False)).cast("int") for c in FEATURES), F.lit(0))
    return df.select("feature_id", "post_id", "split", n.alias("missing")).withColumn("rate", F.round(F.col("missing") / len(FEATURES), 4)).filter(F.col("missing") > most * len(FEATURES))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, value, n`` of categorical and boolean features, and whether the feature is constant."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("feature").agg((F.count("value") <= 1).alias("constant")), "feature")


def relation_features(evidence: DataFrame, key: str = "post_id") -> DataFrame:
    """Counts and shares of evidence relations and their entropy, over rounded shares."""
    n = F.count("*")
    counts = {r: F.count_if(F.col("relation") == r) for r in RELATIONS}
    out = evidence.groupBy(key).agg(n.alias("evidence_count"), F.count_distinct("source").alias("independent_source_count"), *(c.alias(r.lower() + "_count") for r, c in counts.items()))
    for r in RELATIONS:
        out = out.withColumn(r.lower() + "_ratio", ratio(F.col(r.lower() + "_count"), F.col("evidence_count")))
    p = [F.col(r.lower() + "_ratio") for r in RELATIONS]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0))
    return out.withColumns({"evidence_relation_entropy": F.round(entropy, 4), "support_to_contradiction_ratio": F.round(F.col("supports_count") / (F.col("contradicts_count") + 1), 4), "source_diversity": ratio(F.col("independent_source_count"), F.col("evidence_count"))})


def domain_features(links: DataFrame, key: str = "post_id") -> DataFrame:
    """Counts of hosts, official and shortened links; a host's age is not known (-1)."""
    host = T.url_host("url")
    return links.groupBy(key).agg(F.count("*").alias("domain_count"), F.count_distinct(host).alias("unique_domain_count"), F.bool_or(has_any(host, OFFICIAL_HOSTS)).alias("official_domain_match"), F.count_if(has_any(host, SHORTENERS)).alias("shortened_url_count"), F.lit(-1.0).alias("domain_age_days"), F.lit(False).alias("domain_age_available"))


def matrix(posts: DataFrame, parts: list[DataFrame], key: str = "post_id") -> DataFrame:
    """Posts with the features of all parts; a part that has no row for a post gives 0 or false."""
    out = posts
    for part in parts:
        numbers = [c for c, t in part.dtypes if c != key and t != "boolean"]
        flags = [c for c, t in part.dtypes if t == "boolean"]
        out = out.join(part, key, "left").fillna(0, numbers).fillna(False, flags)
    return out


def leaking_columns(columns: list[str]) -> list[str]:
    """Columns whose names tell the label."""
    return [c for c in columns if any(x in c.lower() for x in ("risk_label", "risk_level", "target", "ground_truth", "gold", "answer", "label"))]
