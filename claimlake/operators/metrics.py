"""Evaluation metrics as grouped aggregates and rank windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import word_edit_distance
from .relational import running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("x")).select("x.*")
    out = sides.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    out = out.select("class", "support", _ratio(F.col("hit"), F.col("called")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, n`` of all pairs of classes that occur, 0 included."""
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = cells.select(F.explode(F.array("truth", "predicted")).alias("c")).distinct()
    every = classes.select(F.col("c").alias("truth")).join(F.broadcast(classes.select(F.col("c").alias("predicted"))))  # a few classes
    return every.join(cells, ["truth", "predicted"], "left").fillna(0, ["n"])


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 as means over classes (macro) and weighted by support: one row."""
    rows = per_class(df, truth, predicted)
    macro = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return rows.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"), *macro, *weighted)


def _by_score(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Distinct scores with positives and negatives, and how many of each lie below: counted in ranges of scores."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    return running_totals(counts, "score", {"pos": "pos_below", "neg": "neg_below"})


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by midranks of distinct scores: one row."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    rows = _by_score(df.filter(F.col(truth).isin(0, 1)), F.col(truth) == 1, score)
    return rows.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def one_vs_rest_auc(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """Mean over classes of the area under each class's curve; ``scores`` names the score column of each class."""
    parts = None
    for name, score in scores.items():
        part = roc_auc(df.select((F.col(truth) == name).cast("int").alias("y"), score), "y", score)
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.avg("auc").alias("macro_auc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there: one row."""
    rows = _by_score(df.filter(F.col(truth).isin(0, 1)), F.col(truth) == 1, score)
    total = rows.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))  # one row
    rows = rows.join(F.broadcast(total))
    hits, called = F.col("p") - F.col("pos_below"), F.col("p") + F.col("q") - F.col("pos_below") - F.col("neg_below")  # scored as high or higher
    return rows.agg(F.try_divide(F.sum(F.col("pos") * hits / called), F.max("p").cast("double")).alias("average_precision"))


def ranking(df: DataFrame, query: str, rank: str, relevant: str, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Recall, precision and nDCG at each k and the mean reciprocal rank; queries without relevant items count as 0."""
    hit = F.col(relevant).cast("int")
    gain = hit / F.log2(F.col(rank) + 1)
    aggs = [F.sum(hit).alias("relevant"), F.min(F.when(hit == 1, F.col(rank))).alias("first")]
    for k in ks:
        aggs += [F.sum(F.when(F.col(rank) <= k, hit).otherwise(0)).alias(f"hits_{k}"), F.sum(F.when(F.col(rank) <= k, gain).otherwise(0.0)).alias(f"dcg_{k}")]
    per_query = df.groupBy(query).agg(*aggs)
    out = [F.count("*").alias("queries"), F.avg(_ratio(F.lit(1), F.col("first"))).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.col("relevant"), F.lit(k)), F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
        out += [F.avg(_ratio(F.col(f"hits_{k}"), F.col("relevant"))).alias(f"recall_{k}"), F.avg(F.col(f"hits_{k}") / F.lit(float(k))).alias(f"precision_{k}"), F.avg(F.when(F.col("relevant") > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0)).alias(f"ndcg_{k}")]
    return per_query.agg(*out)


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error with equal bins, the last one closed, and Brier score: one row."""
    edges = [i / bins for i in range(1, bins)]
    at = sum((F.col(score) >= F.lit(e)).cast("int") for e in edges)
    per_bin = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("accuracy"), F.sum(F.pow(F.col(score) - F.col(truth), F.lit(2.0))).alias("square"))
    return per_bin.agg(F.try_divide(F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")), F.sum("n").cast("double")).alias("ece"), F.try_divide(F.sum("square"), F.sum("n").cast("double")).alias("brier"))


def coverage_curve(df: DataFrame, correct: str, confidence: str, cutoffs: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """``cutoff, coverage, selective_accuracy``: what is answered at each cutoff, and how well."""
    answered = [F.count_if(F.col(confidence) >= c) for c in cutoffs]
    right = [F.count_if((F.col(confidence) >= c) & F.col(correct)) for c in cutoffs]
    rows = F.array(*(F.struct(F.lit(c).alias("cutoff"), _ratio(a, F.count("*")).alias("coverage"), _ratio(r, a).alias("selective_accuracy")) for c, a, r in zip(cutoffs, answered, right)))
    return df.agg(rows.alias("x")).select(F.inline("x"))


def error_rate(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Character error rate over all rows: summed distance over summed length."""
    return df.agg(F.try_divide(F.sum(F.levenshtein(reference, hypothesis)), F.greatest(F.sum(F.length(reference)), F.lit(1)).cast("double")).alias("cer"))


def cosine(a: str, b: str) -> Column:
    """0 when a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")


def word_error_rate(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Word error rate over all rows: summed distance over summed length."""
    ref, hyp = _words(F.col(reference)), _words(F.col(hypothesis))
    return df.select(word_edit_distance(ref, hyp).alias("d"), F.size(ref).alias("n")).agg(F.try_divide(F.sum("d"), F.greatest(F.sum("n"), F.lit(1)).cast("double")).alias("wer"))


def sample_metrics(df: DataFrame, truth: str, prediction: str, keep: list[str]) -> DataFrame:
    """``cer, wer, exact_match, annotation_status`` of each row over texts with single spaces; nulls where the truth is not known."""
    clean = lambda c: F.array_join(_words(F.coalesce(c, F.lit(""))), " ")
    rows = df.select(*keep, F.col(truth).isNull().alias("_none"), clean(F.col(truth)).alias("_r"), clean(F.col(prediction)).alias("_p"))
    words = F.size(_words(F.col("_r")))
    one = F.lit(1)
    known = lambda c: F.when(~F.col("_none"), c)
    return rows.select(
        *keep, known(F.levenshtein("_r", "_p") / F.greatest(F.length("_r"), one)).alias("cer"), known(word_edit_distance(_words(F.col("_r")), _words(F.col("_p"))) / F.greatest(words, one)).alias("wer"),
        known((F.col("_r") == F.col("_p")).cast("int")).alias("exact_match"), F.when(F.col("_none"), "MISSING").otherwise("VALID").alias("annotation_status"),
    )


def monotone_share(df: DataFrame, bucket: str, error: str) -> DataFrame:
    """Share of neighbouring buckets whose mean error does not rise; null for under three buckets.  Buckets are few (ten confidences)."""
    means = df.groupBy(bucket).agg(F.avg(error).alias("mean"))
    rows = means.withColumn("_last", F.lag("mean").over(Window.orderBy(bucket)))
    return rows.agg(F.when(F.count("*") >= 3, F.count_if(F.col("_last") >= F.col("mean")) / (F.count("*") - 1)).alias("monotone_fraction"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """``class, prior, majority``: shares of the classes, and which is the most frequent (of equals the first by name)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    most = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "class"))["class"].alias("most"), F.sum("n").alias("all"))  # one row
    return counts.join(F.broadcast(most)).select("class", (F.col("n") / F.col("all")).alias("prior"), (F.col("class") == F.col("most")).alias("majority"))
