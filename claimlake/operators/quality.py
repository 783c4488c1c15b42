"""Quality control of records: reasons for rejection, provenance, clusters, fused scores, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabularies of labels.
SOURCE_TYPES = "PUBLIC_DATASET PROJECT_ANNOTATED SYNTHETIC TRANSLATED HUMAN_REVIEWED LOCAL_DATA USER_PROVIDED".split()
CLAIM_TYPES = "FINANCIAL JOB SHOPPING GIVEAWAY PAYMENT CREDENTIAL IMPERSONATION OTHER UNCLASSIFIED".split()
RELATIONS = "SUPPORTS CONTRADICTS NEUTRAL INSUFFICIENT".split()
RISKS = "LOW MEDIUM HIGH INSUFFICIENT".split()


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def outside(c: str, words: list[str]) -> Column:
    return ~F.coalesce(F.col(c).isin(words), F.lit(False))


def with_reasons(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """``reasons`` of each row, and ``status``."""
    reasons = F.filter(F.array(*(F.when(bad, F.lit(code)) for bad, code in checks)), lambda x: x.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "ACCEPTED").otherwise("REJECTED"))


def referenced(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``found``: whether the parent is there; true for all when there are no parents at all."""
    known = parents.select(key).distinct().withColumn("found", F.lit(True))
    if parents.isEmpty():
        return df.withColumn("found", F.lit(True))
    return df.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def check_posts(posts: DataFrame) -> DataFrame:
    return with_reasons(posts, [(blank("post_id"), "MISSING_REQUIRED_FIELDS"), (blank("text"), "MISSING_CANONICAL_TEXT"), (blank("source_name"), "MISSING_PROVENANCE"), (blank("language"), "INVALID_LANGUAGE")])


def check_claims(claims: DataFrame, posts: DataFrame) -> DataFrame:
    worth = F.col("check_worthiness")
    return with_reasons(referenced(claims, posts, "post_id"), [(blank("claim_id"), "MISSING_REQUIRED_FIELDS"), (blank("claim_text"), "MISSING_CANONICAL_TEXT"), (~F.col("found"), "BROKEN_REFERENCES"), (outside("claim_type", CLAIM_TYPES) | ~F.coalesce(worth.between(0, 1), F.lit(False)), "INVALID_LABELS")])


def check_evidence(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    return with_reasons(referenced(evidence, claims, "claim_id"), [(blank("evidence_id"), "MISSING_REQUIRED_FIELDS"), (blank("evidence_text"), "MISSING_CANONICAL_TEXT"), (~F.col("found"), "BROKEN_REFERENCES"), (outside("relation", RELATIONS), "INVALID_EVIDENCE_RELATION")])


def check_risks(risks: DataFrame, posts: DataFrame) -> DataFrame:
    return with_reasons(referenced(risks, posts, "post_id"), [(blank("risk_id"), "MISSING_REQUIRED_FIELDS"), (~F.col("found"), "BROKEN_REFERENCES"), (outside("risk_level", RISKS), "INVALID_RISK_LABEL")])


def provenance(kind: str, name: str, method: str, licence: str) -> Column:
    """A provenance struct with the licence's default, or null where it is not valid."""
    valid = F.upper(kind).isin(SOURCE_TYPES) & ~blank(name) & ~blank(method)
    return F.when(valid, F.struct(F.upper(kind).alias("source_type"), F.col(name).alias("source_name"), F.col(method).alias("collection_method"), F.coalesce(F.col(licence), F.lit("UNSPECIFIED")).alias("license")))


def cluster_id(campaign: str, translation: str, source: str, own: str, family: str | None = None) -> Column:
    """The first group that a record has, else its own cluster."""
    named = [("camp_", campaign), ("trans_", translation), ("src_", source)] + ([("fam_", family)] if family else [])
    return F.coalesce(*(F.concat(F.lit(p), F.nullif(F.col(c).cast("string"), F.lit(""))) for p, c in named), F.concat(F.lit("post_cluster_" if family else "claim_cluster_"), F.col(own).cast("string")))


def is_synthetic(example: str, source_type: str) -> Column:
    """Whether a record is an example or of a synthetic source."""
    return F.coalesce(F.col(example), F.lit(False)) | F.coalesce(F.col(source_type) == "SYNTHETIC", F.lit(False))


def decision(score: str, evidence: str) -> Column:
    """Risk of a calibrated score, or abstention with fewer than two pieces of evidence."""
    return F.when(F.col(evidence) < 2, "INSUFFICIENT_EVIDENCE").when(F.col(score) > 0.85, "HIGH").when(F.col(score) < 0.3, "LOW").otherwise("MEDIUM")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, before, after, change`` of two counts; values on one side only count 0 on the other."""
    both = old.select(key, F.col("n").alias("before")).join(new.select(key, F.col("n").alias("after")), key, "full").fillna(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


def readiness(posts: DataFrame, split: str, risk: str, synthetic: str) -> DataFrame:
    """One row: counts, and the codes that block training or warn."""
    one = posts.agg(F.count("*").alias("n"), F.count_distinct(risk).alias("risks"), F.count_if((F.col(split) == "test") & F.col(synthetic)).alias("synthetic_in_test"), F.count_if(F.col(split) == "test").alias("n_test"), F.count_if(F.col(split) == "validation").alias("n_validation"))
    codes = lambda checks: F.filter(F.array(*(F.when(c, F.lit(k)) for c, k in checks)), lambda x: x.isNotNull())
    blockers = codes([(F.col("n") == 0, "EMPTY"), (F.col("risks") < 2, "ONE_CLASS"), (F.col("n_test") == 0, "NO_TEST_SPLIT"), (F.col("synthetic_in_test") > 0, "SYNTHETIC_IN_TEST")])
    warnings = codes([(F.col("n_validation") == 0, "NO_VALIDATION_SPLIT"), (F.col("n") < 100, "SMALL")])
    return one.withColumns({"blockers": blockers, "warnings": warnings}).withColumn("ready", F.size("blockers") == 0)


def group_links(posts: DataFrame) -> DataFrame:
    """``post_id, group_key``: the author, campaign (named, else the text's first signal), family, image family and translation group of posts."""
    from ..functions.text import campaign_signals

    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    campaign = F.coalesce(text("campaign"), F.concat(F.lit("camp_"), F.try_element_at(campaign_signals("text"), F.lit(1))))
    keys = [("G_SRC:src_", text("username")), ("G_CAMP:", campaign), ("G_POSTFAM:", text("family")), ("G_IMGFAM:", text("image_family")), ("G_TRANS:", text("translation"))]
    return posts.select("post_id", F.explode(F.array_compact(F.array(*(F.concat(F.lit(p), c) for p, c in keys)))).alias("group_key"))


def linked_posts(posts: DataFrame) -> DataFrame:
    """``post_id, cluster``: posts that groups link, by the smallest id (posts have a ``bigint`` ``ordinal``); a group links all to its first post."""
    from .components import connected_components

    links = group_links(posts).join(posts.select("post_id", "ordinal"), "post_id")
    first = links.groupBy("group_key").agg(F.min("ordinal").alias("a"))
    edges = links.join(first, "group_key").select("a", F.col("ordinal").alias("b")).filter("a <> b")
    found = connected_components(edges, "a", "b")
    return posts.select("post_id", "ordinal").join(found.withColumnRenamed("id", "ordinal"), "ordinal", "left").select("post_id", F.coalesce("component", "ordinal").alias("cluster"))


def verification_pairs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claim and evidence texts with the relation's index, for verification; evidence without a claim has an empty claim text."""
    place = F.array_position(F.array(*map(F.lit, RELATIONS)), F.coalesce("relation", F.lit("INSUFFICIENT"))) - 1
    c = claims.select("claim_id", "claim_text", F.col("language").alias("claim_language"))
    e = evidence.select(F.col("evidence_id").alias("pair_id"), "claim_id", "evidence_text", place.cast("int").alias("label"), F.col("language").alias("evidence_language")).filter("label >= 0")
    rows = e.join(c, "claim_id", "left")
    unknown = F.lit("unknown")
    a, b = F.coalesce("claim_language", unknown), F.coalesce("evidence_language", unknown)
    return rows.select("pair_id", F.coalesce("claim_text", F.lit("")).alias("claim_text"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), "label", a.alias("claim_language"), b.alias("evidence_language"), ((a != b) & (a != unknown) & (b != unknown)).alias("cross_language"))


def unapproved(posts: DataFrame, registry: DataFrame) -> DataFrame:
    """Posts whose source is not approved in the registry, which is a small table (one row for each source)."""
    return posts.join(registry.filter("status = 'APPROVED'").select("source_name"), "source_name", "left_anti")


def conditional_pairs(atoms: DataFrame) -> DataFrame:
    """Payments with the outcomes promised for them in the same claim, as one query text."""
    side = lambda role, c: atoms.filter(F.col("predicate") == role).select("post_id", "claim_ix", F.col("value").alias(c), F.col("time_value").alias(f"{c}_time"))
    rows = side("invests", "paid").join(side("receives", "got"), ["post_id", "claim_ix"])
    return rows.select("post_id", "claim_ix", F.concat_ws(" ", F.lit("investment"), "paid", F.lit("promised return"), "got", "got_time").alias("query_text"))


def task_states(events: DataFrame, task: str, order: str, kind: str) -> DataFrame:
    """``status, rejected_events`` of each task after its events (assign, submit, accept, reject, flag) in order.

    A task is assigned only from PENDING or NEEDS_REVIEW and accepted only after a submission; other events always apply, and those
    that do not are counted.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind])
    start = F.struct(F.lit("PENDING").alias("status"), F.lit(0).alias("submitted"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        refused = ((e == "assign") & ~s["status"].isin("PENDING", "NEEDS_REVIEW")) | ((e == "accept") & (s["submitted"] == 0))
        new = F.when(e == "assign", "IN_PROGRESS").when(e == "submit", "SUBMITTED").when(e == "accept", "ACCEPTED").when(e == "reject", "REJECTED").when(e == "flag", "NEEDS_REVIEW").otherwise(s["status"])
        return F.struct(F.when(refused, s["status"]).otherwise(new).alias("status"), (s["submitted"] + (e == "submit").cast("int")).alias("submitted"), (s["refused"] + refused.cast("int")).alias("refused"))

    out = events.groupBy(task).agg(F.aggregate(steps, start, step).alias("s"))
    return out.select(task, "s.status", F.col("s.submitted").cast("long").alias("submissions"), F.col("s.refused").cast("long").alias("rejected_events"))
