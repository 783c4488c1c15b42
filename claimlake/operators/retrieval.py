"""The retrieval set by token joins: positives, hard negatives, examples, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_text, word_set
from ..plans.lineage import cut
from .relational import keep_first


#: Relations of evidence to its claim, kinds of negatives and their priorities.
POSITIVE = ["SUPPORTS", "CONTRADICTS"]
PRIORITIES = {"HARD_ENTITY_NEGATIVE": 3, "HARD_TOPIC_NEGATIVE": 2, "CROSS_ENTITY_NEGATIVE": 1}


def is_positive() -> Column:
    """Evidence that has a text and supports or contradicts its claim."""
    return (F.trim(F.coalesce("evidence_text", F.lit(""))) != "") & F.coalesce(F.col("relation").isin(POSITIVE), F.lit(False))


def positives(evidence: DataFrame, order: str) -> DataFrame:
    """The first positive evidence of each claim."""
    return keep_first(evidence.filter(is_positive()), ["claim_id"], [F.col(order), F.col("evidence_id")])


def pool(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence with its claim's split; train where the claim or its split is unknown."""
    splits = claims.select("claim_id", F.col("split").alias("_split"))
    return evidence.join(splits, "claim_id", "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def _similarity(both: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity of two sets from their common words and their sizes; 0 of empty ones."""
    return F.coalesce(F.try_divide(both.cast("double"), (n + m - both).cast("double")), F.lit(0.0))


def _nearest(queries: DataFrame, texts: DataFrame, k: int, probe: int = 3) -> DataFrame:
    """``query_id, text_id, raw``: for each query all texts of its group that share a word and may be among its k most alike ones.

    Words are taken by rarity.  The k-th best among the texts that hold one of the ``probe`` rarest gives a bound t.  A set of m words at least
    that alike to a query of n shares t / (1 + t) (n + m) words with it, so it holds one of the query's rarest, all but that many less one of
    those that texts have, and only these are joined: common words are left out wherever the bound allows.  Both tables have an id,
    ``group``, ``n`` (words of the set) and ``words``, of which those that the other table has none of may be missing.
    """
    inverted = texts.select("group", "text_id", F.explode("words").alias("word"))
    rarity = cut(inverted.groupBy("group", "word").agg(F.count("*").alias("df")))
    least = texts.filter(F.size("words") > 0).groupBy("group").agg(F.min("n").alias("least"))
    ranked = queries.select("query_id", "group", "n", F.explode("words").alias("word")).join(rarity, ["group", "word"]).join(least, "group")  # words that no text has are of no use
    of_query = Window.partitionBy("query_id")
    ranked = cut(ranked.withColumns({"place": F.row_number().over(of_query.orderBy("df", "word")), "held": F.count("*").over(of_query)}))

    def alike(words: DataFrame) -> DataFrame:
        pairs = words.join(inverted, ["group", "word"]).select("query_id", "text_id").distinct()
        q, t = queries.select("query_id", F.col("words").alias("q"), F.col("n").alias("n_q")), texts.select("text_id", F.col("words").alias("t"), F.col("n").alias("n_t"))
        both = F.size(F.array_intersect("q", "t"))
        return pairs.join(q, "query_id").join(t, "text_id").select("query_id", "text_id", _similarity(both, F.col("n_q"), F.col("n_t")).alias("raw"))

    near = cut(alike(ranked.filter(F.col("place") <= probe)))
    best = near.withColumn("at", F.row_number().over(of_query.orderBy(F.desc("raw")))).filter(F.col("at") == k).select("query_id", F.greatest(F.col("raw") - 1e-4, F.lit(0.0)).alias("bound"))  # similarities are compared rounded
    bound = F.coalesce("bound", F.lit(0.0))
    shared = F.greatest(F.ceil(bound / (1 + bound) * (F.col("n") + F.col("least")) - 1e-9), F.lit(1))
    longer = ranked.join(best, "query_id", "left").filter(F.col("place") <= F.col("held") - shared + 1)
    return alike(longer.select("query_id", "group", "word"))


def most_alike(queries: DataFrame, texts: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, text_id, similarity, rank``: the k texts most alike by words, of equals the larger id; both tables have ``id, text``."""
    q = cut(queries.select(F.col("id").alias("query_id"), F.lit(0).alias("group"), word_set("text").alias("words")).withColumn("n", F.size("words")))
    t = cut(texts.select(F.col("id").alias("text_id"), F.lit(0).alias("group"), word_set("text").alias("words")).withColumn("n", F.size("words")))
    found = _nearest(q, t, k).withColumn("similarity", F.round("raw", 4))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("text_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("raw")


def _classed(rows: DataFrame, key: str, shared: DataFrame) -> DataFrame:
    """``rows`` (``key, group, words``) with ``n``, their number of words, ``words``, those of ``shared`` only, and ``class``, one for equals in group, n and words."""
    kept = rows.select(key, "group", F.explode("words").alias("word")).join(shared, ["group", "word"]).groupBy(key).agg(F.array_sort(F.collect_list("word")).alias("kept"))
    out = rows.join(kept, key, "left").withColumns({"n": F.size("words"), "words": F.coalesce("kept", F.array().cast("array<string>"))}).drop("kept")
    return cut(out.withColumn("class", F.xxhash64("group", "n", F.to_json("words"))))


def hard_negatives(queries: DataFrame, evidence: DataFrame, k: int = 3) -> DataFrame:
    """``claim_id, evidence_id, relation, negative_type, similarity, rank``: the k best negatives of each claim in its split.

    Negatives neither support nor contradict; they are ranked by word similarity to the query, then by kind, then by id (all
    descending), one for each text.  ``queries`` has ``claim_id, split, query_text``, ``evidence`` is a ``pool``.
    Equal texts of a split are one from the start; where under k share a word, the best of the split fill up.

    Only words that queries and texts of a split share count, besides the number of all: texts with the same ones and as many words are equally alike to every
    query, so only the k best of such a class can be found, and queries of a class find the same texts.  So classes are compared, and
    each query's own evidence, which ranks higher for it alone, is put beside what its class found.
    """
    rows = evidence.filter(~F.coalesce(F.col("relation").isin(POSITIVE), F.lit(False))).select("evidence_id", F.col("claim_id").alias("own_claim"), "relation", "split", F.coalesce("evidence_text", F.lit("")).alias("evidence_text"))
    kind = F.when(F.col("relation") == "NEUTRAL", "HARD_TOPIC_NEGATIVE").otherwise("CROSS_ENTITY_NEGATIVE")
    priority = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair]), F.col("negative_type"))
    rows = cut(rows.withColumn("negative_type", kind).withColumn("priority", priority))
    best = F.max(F.struct("priority", "evidence_id", "relation", "negative_type"))
    texts = rows.groupBy("split", "evidence_text").agg(best.alias("x")).select(F.xxhash64("split", "evidence_text").alias("text_id"), F.col("split").alias("group"), "evidence_text", "x.*")
    texts = cut(texts.withColumn("words", word_set("evidence_text")))
    asked = cut(queries.select(F.col("claim_id").alias("query_id"), F.col("split").alias("group"), word_set("query_text").alias("words")))
    of = lambda df: df.select("group", F.explode("words").alias("word")).distinct()
    shared = cut(of(asked).join(of(texts), ["group", "word"]))
    texts, asked = _classed(texts, "text_id", shared), _classed(asked, "query_id", shared)
    rank = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    order = [F.desc("priority"), F.desc("evidence_id")]
    found_by_text = ["evidence_text", "priority", "evidence_id", "relation", "negative_type"]
    first = texts.withColumn("at", rank("class", *order)).filter(F.col("at") <= k).select("class", *found_by_text)
    kinds = cut(asked.select(F.col("class").alias("query_id"), "group", "words", "n").dropDuplicates(["query_id"]))
    of_texts = cut(texts.select(F.col("class").alias("text_id"), "group", "words", "n").dropDuplicates(["text_id"]))
    near = _nearest(kinds, of_texts, k).join(first.withColumnRenamed("class", "text_id"), "text_id").drop("text_id")
    head = texts.withColumn("at", rank("group", *order)).filter(F.col("at") <= 2 * k).select("group", F.col("words").alias("w"), F.col("n").alias("m"), *found_by_text)  # 2 k rows of each split
    fill = kinds.join(F.broadcast(head), "group").withColumn("raw", _similarity(F.size(F.array_intersect("words", "w")), F.col("n"), F.col("m")))
    order = [F.desc("similarity"), *order]
    columns = ["query_id", "similarity", *found_by_text]
    of_class = near.withColumn("similarity", F.round("raw", 4)).select(columns).unionByName(fill.withColumn("similarity", F.round("raw", 4)).select(columns)).distinct()
    of_class = cut(of_class.withColumn("at", rank("query_id", *order)).filter(F.col("at") <= k).drop("at").withColumnRenamed("query_id", "class"))
    own = rows.withColumn("negative_type", F.lit("HARD_ENTITY_NEGATIVE")).withColumn("priority", priority).withColumn("w", word_set("evidence_text"))
    own = queries.select(F.col("claim_id").alias("query_id"), F.col("split").alias("group"), word_set("query_text").alias("q")).join(own, (F.col("query_id") == F.col("own_claim")) & (F.col("group") == F.col("split")))
    own = own.withColumn("similarity", F.round(_similarity(F.size(F.array_intersect("q", "w")), F.size("q"), F.size("w")), 4))
    found = asked.select("query_id", "class").join(of_class, "class").select(columns).unionByName(own.select(columns))
    once = keep_first(found, ["query_id", "evidence_text"], order)
    once = once.withColumn("rank", rank("query_id", *order)).filter(F.col("rank") <= k)
    return once.select(F.col("query_id").alias("claim_id"), "evidence_id", "evidence_text", "relation", "negative_type", "similarity", "rank")


def query_variants(claims: DataFrame) -> DataFrame:
    """``claim_id, variant, query_id, query_text, query_type``: the claim as a query, and its first words with a registration."""
    text, kind = search_text("claim_text"), F.upper("claim_type")
    words = F.filter(F.split("query_text", " "), lambda w: w != "")
    of = F.when(kind.isin("FINANCIAL", "INVESTMENT"), "FINANCIAL").when(kind == "TEMPORAL", "TEMPORAL").otherwise("VERIFICATION")
    rows = claims.select("claim_id", text.alias("query_text"), of.alias("query_type"))
    entity = F.when(F.size(words) >= 4, F.struct(F.lit(2).alias("variant"), F.concat(F.array_join(F.slice(words, 1, 5), " "), F.lit(" official registration")).alias("query_text"), F.lit("ENTITY").alias("query_type")))
    both = F.array_compact(F.array(F.struct(F.lit(1).alias("variant"), "query_text", "query_type"), entity))
    rows = rows.select("claim_id", F.inline(both))
    return rows.withColumn("query_id", F.format_string("q_%s_%02d", "claim_id", "variant"))


def examples(claims: DataFrame, evidence: DataFrame, order: str, k: int = 3, review_every: int = 4) -> DataFrame:
    """One example for each claim that has a positive and a negative, in the claims' order, with its negatives as an array.

    ``claims`` has ``claim_id, claim_text, claim_type, language, split, cluster_id`` and the column ``order``.  Numbers come from a
    count of the claims before each in ranges of ``order`` (``numbered``).
    """
    from .relational import numbered

    known = claims.withColumn("split", F.coalesce("split", F.lit("train")))
    first = query_variants(known).filter("variant = 1").drop("variant")
    found = positives(evidence, "evidence_id").select("claim_id", F.col("evidence_id").alias("positive_id"), F.col("evidence_text").alias("positive_text"), F.col("relation").alias("positive_relation"), F.coalesce("language", F.lit("en")).alias("evidence_language"))
    rows = known.join(first, "claim_id").join(found, "claim_id")
    negatives = hard_negatives(rows.select("claim_id", "split", "query_text"), pool(evidence, claims), k)
    lists = negatives.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "evidence_text", "relation", "negative_type", "similarity"))).alias("negatives"))
    rows = numbered(rows.join(lists, "claim_id"), order, "at")
    language = F.coalesce("language", F.lit("en"))
    return rows.select(
        F.format_string("ret_%06d", "at").alias("retrieval_id"), "claim_id", "query_id", "query_text", "query_type", "positive_id", "positive_text", "positive_relation",
        F.col("negatives")[0]["evidence_id"].alias("negative_id"), F.col("negatives")[0]["negative_type"].alias("negative_type"), "negatives",
        language.alias("query_language"), "evidence_language", (language != F.col("evidence_language")).alias("cross_language"), "split", "cluster_id", (F.col("at") % review_every == 0).alias("human_reviewed"),
    )


def pairs(examples: DataFrame) -> DataFrame:
    """Labelled pairs: each example's positive (1) and negatives (0)."""
    common = ["retrieval_id", "query_id", "query_text", "split", "cluster_id", "cross_language"]
    name = lambda tail: F.concat(F.lit("pair_"), F.substring("retrieval_id", 5, 100), tail)
    yes = examples.select(name(F.lit("_pos")).alias("pair_id"), *common, F.col("positive_id").alias("evidence_id"), F.col("positive_text").alias("document_text"), F.lit(1).alias("label"), F.col("positive_relation").alias("relation"), F.lit(None).cast("string").alias("negative_type"))
    no = examples.select(*common, F.posexplode("negatives").alias("ix", "n"))
    no = no.select(name(F.concat(F.lit("_neg_"), (F.col("ix") + 1).cast("string"))).alias("pair_id"), *common, "n.evidence_id", F.col("n.evidence_text").alias("document_text"), F.lit(0).alias("label"), "n.relation", "n.negative_type")
    return yes.unionByName(no)


def evaluation_pool(examples: DataFrame, split: str = "test") -> DataFrame:
    """Of each example of a split: its relevant evidence and all candidates."""
    none = F.lit(None).cast("string")
    best = F.array(F.struct(F.col("positive_id").alias("evidence_id"), F.lit(True).alias("is_relevant"), F.col("positive_relation").alias("relation"), none.alias("negative_type"), F.lit(None).cast("double").alias("similarity")))
    rest = F.transform("negatives", lambda n: F.struct(n["evidence_id"].alias("evidence_id"), F.lit(False).alias("is_relevant"), none.alias("relation"), n["negative_type"].alias("negative_type"), F.lit(None).cast("double").alias("similarity")))
    return examples.filter(F.col("split") == split).select("query_id", "claim_id", F.array("positive_id").alias("relevant_ids"), F.concat(best, rest).alias("candidates"), "cluster_id")


def manifest(examples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of an example set: one row."""
    flat = examples.withColumn("n_negatives", F.size("negatives"))
    one = flat.agg(F.count("*").alias("records"), F.count_distinct("query_id").alias("queries"), F.count_distinct("positive_id").alias("positives"), F.count_distinct("cluster_id").alias("clusters"), F.sum("n_negatives").alias("negatives"), F.count_if("cross_language").alias("cross_language"), F.count_if("human_reviewed").alias("reviewed"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")))
    return one.join(F.broadcast(pairs.agg(F.count("*").alias("pairs"))))  # one row each


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """How many (query, evidence) pairs repeat an earlier one: one row."""
    return pairs.groupBy("query_id", "evidence_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"))
