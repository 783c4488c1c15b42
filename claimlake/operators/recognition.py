"""Scores of recognised text: script evidence, selection, reliability, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAMIL, LATIN = r"[\x{0B80}-\x{0BFF}]", r"[A-Za-z\x{00C0}-\x{024F}]"
VALID = r"[\x{0B80}-\x{0BFF}A-Za-z0-9\x{00C0}-\x{024F}₹$€£.,!?:;'\"()\-/%@#&+]"


def share(text: str, pattern: str) -> Column:
    """Part of the characters other than white space that match; 0 for empty texts."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s\p{Z}]+", "")
    return F.when(F.length(bare) > 0, F.regexp_count(bare, F.lit(pattern)) / F.length(bare)).otherwise(0.0)


def language_label(text: str) -> Column:
    """ta, mixed, en or unknown by the shares of Tamil and Latin letters."""
    return script_label(share(text, TAMIL), share(text, LATIN))


def script_label(ta: Column, la: Column) -> Column:
    return F.when(ta >= 0.5, "ta").when((ta > 0) & (la > 0), "mixed").when(la >= 0.5, "en").when(ta > 0, "ta").when(la > 0, "en").otherwise("unknown")


def labelled_shares(text: str) -> Column:
    """Rows of one array: ``ta, la``, the shares of ``language_label``; to be generated, so that the text is read once for each script."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s\p{Z}]+", "")
    part = lambda bare, pattern: F.when(F.length(bare) > 0, F.regexp_count(bare, F.lit(pattern)) / F.length(bare)).otherwise(0.0)
    return F.transform(F.array(t), lambda bare: F.struct(part(bare, TAMIL).alias("ta"), part(bare, LATIN).alias("la")))


def quality_level(text: str, confidence: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "failed").when(F.col(confidence) >= 0.85, "high").when(F.col(confidence) >= 0.60, "medium").otherwise("low")


def clamp(c: Column) -> Column:
    return F.greatest(F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def usable(text: str, confidence: str, mode: str) -> Column:
    """Text there, confidence of .60, and Tamil letters where Tamil is read."""
    return (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (F.coalesce(F.col(confidence), F.lit(0.0)) >= 0.60) & ((F.col(mode) != "ta") | (share(text, TAMIL) > 0))


def selection_score(text: str, confidence: str, mode: str, detections: str) -> Column:
    script = F.when(F.col(mode) == "ta", share(text, TAMIL)).otherwise(share(text, LATIN))
    return F.round(0.45 * clamp(F.col(confidence)) + 0.25 * script + 0.15 * F.least(F.length(text) / 50, F.lit(1.0)) + 0.15 * F.least(F.col(detections) / 10, F.lit(1.0)), 4)


def reliability(text: str, confidence: str, regions: str, mode: str, most_length: int = 50, most_regions: int = 10) -> Column:
    """.40 confidence, .20 script, .20 valid characters, .10 length, .10 regions (an array of confidences)."""
    n = F.size(regions)
    mean = F.when(n > 0, F.aggregate(regions, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    region = F.when(n > 0, 0.6 * mean + 0.4 * F.least(n / most_regions, F.lit(1.0))).otherwise(0.0)
    script = F.when(F.col(mode) == "ta", share(text, TAMIL)).otherwise(1 - share(text, TAMIL))
    return F.round(clamp(0.40 * clamp(F.col(confidence)) + 0.20 * script + 0.20 * share(text, VALID) + 0.10 * F.least(F.length(F.trim(text)) / most_length, F.lit(1.0)) + 0.10 * region), 4)


def status(text: str, score: Column) -> Column:
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return F.when(t == "", "OCR_FAILED").when(F.length(t) < 3, "PARTIAL").when((share(text, TAMIL) == 0) & (share(text, VALID) < 0.10), "LANGUAGE_UNCERTAIN").when(score < 0.45, "LOW_CONFIDENCE").otherwise("SUCCESS")


def best_candidate(candidates: DataFrame, image: str, text: str, confidence: str, mode: str, detections: str, order: str) -> DataFrame:
    """One candidate for each image: usable first, then with text, then by score; the first of equals by ``order``, which is unique in an image.

    Only keys and scores are compared, in partial aggregates; texts are joined to the winners.
    """
    rows = candidates.withColumns({"usable": usable(text, confidence, mode), "score": selection_score(text, confidence, mode, detections)})
    some = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    best = rows.groupBy(image).agg(F.min(F.struct((~F.col("usable")).alias("u"), (~some).alias("e"), (-F.col("score")).alias("s"), F.col(order).alias("o")))["o"].alias(order))
    return rows.join(best, [image, order], "left_semi")


def confidence_bucket(confidence: str) -> Column:
    low = F.greatest(F.least(F.floor(F.col(confidence) * 10), F.lit(9)), F.lit(0))
    return F.when(F.col(confidence).isNull(), "unavailable").otherwise(F.format_string("%.2f-%.2f", low / 10, (low + 1) / 10))


def confidence_verdict(df: DataFrame, confidence: str, accuracy: str) -> DataFrame:
    """Population Pearson's r with a floor for the deviations, and what it says: one row."""
    r = F.covar_pop(confidence, accuracy) / (F.greatest(F.stddev_pop(confidence), F.lit(1e-9)) * F.greatest(F.stddev_pop(accuracy), F.lit(1e-9)))
    return df.agg(r.alias("r")).withColumn("verdict", F.when(F.abs("r") < 0.3, "POOR").when(F.abs("r") < 0.6, "MODERATE").otherwise("GOOD"))


def signal_evaluation(df: DataFrame, score: str, good: str, cutoff: float) -> DataFrame:
    """Precision, recall and accuracy of ``score >= cutoff`` as a signal of ``good``: one row."""
    yes = F.col(score) >= cutoff
    tp, fp, fn, tn = F.count_if(yes & F.col(good)), F.count_if(yes & ~F.col(good)), F.count_if(~yes & F.col(good)), F.count_if(~yes & ~F.col(good))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return df.agg(part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(fp, fp + tn).alias("false_accept_rate"), part(tn, fp + tn).alias("correct_reject_rate"))


def character_errors(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """``key, at, expected, found, error`` where the characters at a place differ and one is Tamil, lengths included; with the kind of error."""
    pairs = F.arrays_zip(F.split(reference, "").alias("expected"), F.split(hypothesis, "").alias("found"))
    rows = df.select(key, F.posexplode(pairs).alias("at", "x")).select(key, "at", F.nullif("x.expected", F.lit("")).alias("expected"), F.nullif("x.found", F.lit("")).alias("found"))
    tamil = lambda c: F.coalesce(F.col(c).rlike(TAMIL), F.lit(False))
    ascii_ = lambda c: F.coalesce(F.col(c).rlike(r"^[\x00-\x7F]$"), F.lit(False))
    mark = F.col("expected").rlike(r"\p{Mn}") | F.col("found").rlike(r"\p{Mn}")
    kind = (
        F.when(F.col("found").isNull(), "deletion").when(F.col("expected").isNull(), "insertion").when(tamil("expected") & tamil("found") & mark, "vowel_modifier_error").when(tamil("expected") & tamil("found"), "tamil_substitution")
        .when(tamil("expected") & ascii_("found"), "tamil_to_latin_confusion").when(ascii_("expected") & tamil("found"), "latin_to_tamil_confusion").otherwise("other_substitution")
    )
    return rows.filter(~F.col("expected").eqNullSafe(F.col("found")) & (tamil("expected") | tamil("found"))).withColumn("error", kind)


def alphanumeric_share(text: str) -> Column:
    return share(text, r"[\p{L}\p{N}]")


def warnings(text: str, confidence: str, mode: str, detections: str) -> Column:
    """Codes of what is doubtful about a candidate; for an empty text only that and its confidence."""
    conf, t = F.coalesce(F.col(confidence), F.lit(0.0)), F.trim(F.coalesce(F.col(text), F.lit("")))
    value = lambda name, x: F.concat(F.lit(name + ":"), F.format_number(x, 3))
    some, alnum, valid, ta = t != "", alphanumeric_share(text), share(text, VALID), share(text, TAMIL)
    checks = [
        (conf < 0.60, value("confidence_below_gate", conf)), (~some, F.lit("empty_ocr_output")), (some & (alnum < 0.30), value("low_alphanumeric_ratio", alnum)), (some & (valid < 0.40), value("low_valid_char_ratio", valid)),
        (some & (F.col(mode) == "ta") & (ta < 0.05), F.lit("tamil_ocr_no_tamil_chars")), (some & (F.col(mode) == "en") & (ta > 0.50), F.lit("english_ocr_high_tamil_ratio")),
        (some & (F.col(detections) > 5) & (F.length(t) < 10), F.lit("suspiciously_short_text_for_detection_count")),
    ]
    return F.array_compact(F.array(*(F.when(c, x) for c, x in checks)))


def fused_score(text: str, confidence: str, expected: str) -> Column:
    """The older score: .40 confidence, .25 script, .20 valid characters, .15 length."""
    ta = share(text, TAMIL)
    return 0.40 * F.coalesce(F.col(confidence), F.lit(0.0)) + 0.25 * (ta if expected == "ta" else 1 - ta) + 0.20 * share(text, VALID) + 0.15 * F.least(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) / 50, F.lit(1.0))


def fused_choice(df: DataFrame, en: tuple[str, str], ta: tuple[str, str]) -> DataFrame:
    """``chosen, text``: Tamil only where there is a text and its score is strictly better."""
    better = (F.coalesce(F.col(ta[0]), F.lit("")) != "") & (fused_score(*ta, "ta") > fused_score(*en, "en"))
    return df.withColumn("chosen", F.when(better, "ta").otherwise("en")).withColumn("text", F.when(better, F.col(ta[0])).otherwise(F.col(en[0])))


def reading_order(df: DataFrame, image: str, x: str, y: str, text: str) -> DataFrame:
    """Lines of each image by rows of 15 pixels, then from the left; exact repeats once."""
    lines = F.array_sort(F.collect_list(F.struct(F.round(F.col(y) / 15).alias("row"), F.col(x).alias("x"), F.col(text).alias("text"))))
    return df.groupBy(image).agg(F.array_distinct(F.transform(lines, lambda s: s["text"])).alias("lines"))
