"""Column functions over texts: cleaning, keys, scripts, languages, claims, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(text: C) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(col(text), r"[\s\p{Z}]+", " "))


def without_controls(text: C) -> Column:
    """Control, format and unassigned characters removed, but for line ends and tabs."""
    return F.regexp_replace(col(text), r"[\p{C}&&[^\n\r\t]]", "")


def tidy_layout(text: C) -> Column:
    """Runs of spaces squeezed, spaces around line ends removed, at most one blank line kept."""
    squeezed = F.regexp_replace(col(text), r"[ \t]+", " ")
    trimmed = F.regexp_replace(squeezed, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def plain_punctuation(text: C) -> Column:
    """Curly quotes and dashes to ASCII."""
    return F.translate(F.translate(F.translate(col(text), "“”", '""'), "‘’", "''"), "—–", "--")


def minimal_clean(text: C) -> Column:
    """Composed text without control and format characters, white space collapsed; null as empty."""
    from .unicode import nfc

    bare = F.regexp_replace(nfc(F.coalesce(col(text), F.lit(""))), r"[\p{Cc}\p{Cf}&&[^\t\n]]", "")
    return collapse(bare)


def recognised(text: C) -> Column:
    """``struct<raw, text>``: recognised text as it was and after the whole cleaning chain; null as empty."""
    from .unicode import nfc

    raw = F.coalesce(col(text), F.lit(""))
    return F.struct(raw.alias("raw"), ocr_clean(nfc(raw)).alias("text"))


def ocr_clean(text: C) -> Column:
    """The cleaning chain of recognised text, but for Unicode composition (``functions.unicode.nfc``)."""
    return tidy_layout(plain_punctuation(without_controls(text)))


def text_key(text: C) -> Column:
    """SHA-256 of the lower-cased words joined by single spaces."""
    words = F.filter(F.split(F.lower(col(text)), r"[\s\p{Z}]+"), lambda w: w != "")
    return F.sha2(F.array_join(words, " "), 256)


def char_shingles(text: C, n: int = 3) -> Column:
    """Distinct character n-grams of the collapsed lower-case text; a shorter text is its own only member.

    The text is cut into pieces of n characters from each of its first n places on, so that no lambda runs for each character; as
    a one-element array whose lambda sees it as a value it is collapsed once.
    """
    whole = F.filter(F.array(collapse(F.lower(col(text)))), lambda t: t != "")
    pieces = lambda t: F.flatten(F.array(*(F.regexp_extract_all(F.substring(t, k + 1, 2**31 - 1), F.lit(rf"(?s).{{{n}}}"), F.lit(0)) for k in range(n))))
    return F.array_distinct(F.flatten(F.transform(whole, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(pieces(t)))))


def jaccard(a: C, b: C) -> Column:
    """Of two arrays; 1 when both are empty."""
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: C) -> Column:
    """Distinct lower-case words longer than two characters."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


#: Letter ranges of the scripts told apart, in the order of reports.
SCRIPTS = {"Latin": r"\x{0041}-\x{024F}", "Tamil": r"\x{0B80}-\x{0BFF}", "Devanagari": r"\x{0900}-\x{097F}", "Arabic": r"\x{0600}-\x{06FF}"}


def script_counts(text: C) -> Column:
    """Letters of each script as a struct."""
    t = F.coalesce(col(text), F.lit(""))
    known = {name: F.regexp_count(t, F.lit(rf"[\p{{L}}&&[{r}]]")) for name, r in SCRIPTS.items()}
    rest = F.regexp_count(t, F.lit(r"[\p{L}&&[^" + "".join(SCRIPTS.values()) + "]]"))
    return F.struct(*(c.alias(name) for name, c in known.items()), rest.alias("Unknown"))


#: A word's edge where words are runs of letters, numbers and underscores only, so not beside a combining mark.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


#: A word's edge where words are runs of ASCII letters, digits and underscores, as DuckDB's ``\\b`` has it; Java's takes other letters for words too.
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def edged(pattern: str, edge: str = EDGE) -> str:
    """A pattern whose ``\\b`` means ``edge``."""
    return pattern.replace(r"\b", edge)


#: Words that tell a language in Latin script.
ENGLISH = "a an and apply are but can congratulations every for from good hello is job month offer pay ready registration selected the this to work with you".split()
TAMIL_LATIN = "naan oru nee unga ungal irukku iruken pannunga pannanum venum illa romba nalla inga anga indha theduren panna velai kidaikkum kudunga".split()
HINDI_LATIN = "hai hain mera meri aap apka kya nahi karna chahiye paisa paise milega accha job kaam yeh woh".split()
#: A link in a text.
URL = r"(?i)https?://\S+|www\.\S+"


def language_tokens(text: C) -> Column:
    """Distinct tokens that speak for English, Tamil and Hindi: ``struct<en, ta, hi: array<string>>``."""
    bare = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), URL, " "))
    tokens = F.regexp_extract_all(bare, F.lit(rf"(?<![@#]){EDGE}([\p{{L}}\p{{N}}_']+){EDGE}"), F.lit(1))
    tokens = F.array_distinct(F.filter(F.transform(F.array_distinct(tokens), lambda t: F.regexp_replace(t, "^'+|'+$", "")), lambda t: ~t.rlike(r"^\p{N}*$")))
    tamil, hindi = r"[\x{0B80}-\x{0BFF}]", r"[\x{0900}-\x{097F}]"
    among = lambda words: (lambda t: ~t.rlike(tamil) & ~t.rlike(hindi) & t.isin(words))

    def told(tokens: Column) -> Column:
        en = F.filter(tokens, among(ENGLISH))
        ta = F.filter(tokens, lambda t: t.rlike(tamil) | (among(TAMIL_LATIN)(t) & ~t.isin(ENGLISH)))
        hi = F.filter(tokens, lambda t: (~t.rlike(tamil) & t.rlike(hindi)) | (among(HINDI_LATIN)(t) & ~t.isin(ENGLISH + TAMIL_LATIN)))
        return F.struct(en.alias("en"), ta.alias("ta"), hi.alias("hi"))

    return F.transform(F.array(tokens), told)[0]  # tokens are sought once


def code_mix(tokens: Column, counts: Column) -> Column:
    """``struct<mixed, confidence>``: two languages by tokens, else two known scripts."""
    languages = sum((F.size(tokens[k]) > 0).cast("int") for k in ("en", "ta", "hi"))
    scripts = sum((counts[s] > 0).cast("int") for s in SCRIPTS)
    by_script = sum(((counts[s] > 0).cast("int") for s in ("Tamil", "Devanagari")), F.greatest((counts["Latin"] > 0).cast("int"), (counts["Arabic"] > 0).cast("int"), (counts["Unknown"] > 0).cast("int")))
    mixed = (languages >= 2) | ((scripts >= 2) & (by_script >= 2))
    n = sum(F.size(tokens[k]) for k in ("en", "ta", "hi"))
    return F.struct(mixed.alias("mixed"), F.when(mixed, F.round(F.least(F.lit(0.95), 0.6 + 0.1 * F.least(n, F.lit(3))), 4)).otherwise(0.0).alias("confidence"))


def transliteration(tokens: Column, counts: Column) -> Column:
    """``struct<language, confidence>`` of Tamil or Hindi in Latin script; null where there is none."""
    ta, hi = F.size(tokens["ta"]), F.size(tokens["hi"])
    other = (counts["Tamil"] > 0) | (counts["Devanagari"] > 0) | (counts["Arabic"] > 0)
    some = ~other & ((ta > 0) | (hi > 0))
    return F.when(some, F.struct(F.when(ta >= hi, "ta").otherwise("hi").alias("language"), F.round(F.least(F.lit(0.95), 0.65 + 0.08 * F.least(F.greatest(ta, hi), F.lit(3))), 4).alias("confidence")))


def script_shares(counts: Column) -> Column:
    """Shares of letters by script, rounded to 4; 0 without letters."""
    names = [*SCRIPTS, "Unknown"]
    total = sum((counts[n] for n in names), F.lit(0))
    return F.struct(*(F.when(total > 0, F.round(counts[n] / total, 4)).otherwise(0.0).alias(n) for n in names))


def language_decision(text: C, tokens: Column, counts: Column, detected: Column, confidence: Column) -> Column:
    """``struct<language, confidence, secondary, mixed>``: the script decides, then Latin-script words, then the detector.

    ``tokens`` and ``counts`` are of ``language_tokens`` and ``script_counts``.
    """
    mix, latin = code_mix(tokens, counts), transliteration(tokens, counts)
    has = lambda s: counts[s] > 0
    by_token = F.array_compact(F.array(*(F.when(F.size(tokens[k]) > 0, F.lit(k)) for k in ("en", "ta", "hi"))))
    any_script = sum((has(s).cast("int") for s in SCRIPTS), F.lit(0)) >= 2
    by_script = F.array_distinct(F.array_compact(F.array(F.when(has("Latin"), F.lit("en")), F.when(has("Tamil"), F.lit("ta")), F.when(has("Devanagari"), F.lit("hi")), F.when(has("Arabic") | has("Unknown"), F.lit("en")))))
    languages = F.when((F.size(by_token) < 2) & any_script, by_script).otherwise(by_token)
    primary = F.when(has("Tamil"), "ta").when(has("Devanagari"), "hi").otherwise(detected)
    primary = F.coalesce(latin["language"], primary)
    primary = F.when((primary == "en") & F.array_contains(languages, "ta"), "ta").otherwise(primary)
    mixed = mix["mixed"] | (has("Latin") & (has("Tamil") | has("Devanagari")))
    secondary = F.array_remove(languages, primary)
    secondary = F.when(mixed & (primary != "en") & ~F.array_contains(secondary, "en") & has("Latin"), F.array_append(secondary, F.lit("en"))).otherwise(secondary)
    decided = F.struct(primary.alias("language"), F.when(primary.isin("hi", "ta"), 0.99).otherwise(confidence).alias("confidence"), secondary.alias("secondary"), mixed.alias("mixed"))
    none = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("secondary"), F.lit(False).alias("mixed"))
    return F.when(F.trim(F.coalesce(col(text), F.lit(""))) == "", none).otherwise(decided)


#: The tests for a claim's type, first match wins, and whether such a claim can be verified.
CLAIM_TESTS = [
    ("QUESTION", r"\?|என்ன|எப்படி|எங்கே|யார்", False),
    ("OPINION", r"(?i)\b(i think|i feel|maybe|probably|நினைக்கிறேன்|தோன்றுகிறது)\b", False),
    ("REQUEST", r"(?i)\b(dm me|message me|send|provide|give|whatsapp me|அனுப்பு|தொடர்பு)\b", False),
    ("INSTRUCTION", r"(?i)\b(apply|click|register|join|share|பதிவு|கிளிக்)\b", False),
    ("CONTEXTUAL", r"(?i)\b(received|saw|found|message yesterday|கிடைத்தது|பார்த்தேன்)\b", False),
    ("GUARANTEE", r"(?i)\b(guarantee|guarantees|assured|100%|sure|உறுதி|கண்டிப்பாக|நிச்சயம்)\b", True),
    ("FINANCIAL", r"(?i)(₹|\$|earn|earns|profit|return|returns|money|pay|fee|income|investment|invest|receive|லாபம்|வருமானம்|பணம்|முதலீடு)", True),
]
#: What makes a claim numerical or factual, its quantities and its negation.
QUANTITY = r"(?i)\b(customers|users|people|employees)\b"
FACT = r"(?i)\b(founded|headquartered_in|headquarters|approved|registered|located|owns|operates|has)\b"
NUMBER = r"(?i)\b\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?\b"
AMOUNT = r"(?i)(?:₹|\$|rs\.?|rupees?|dollars?)\s*\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?|\d+(?:,\d+)*(?:\.\d+)?(?:k|m|b)?\s*(?:₹|\$|rs\.?|rupees?|dollars?)"
PERCENT = r"\d+(?:\.\d+)?\s*%"
NEGATION = r"(?i)\b(not|no|never|இல்லை|கிடையாது|नहीं)\b"


def _words_of(pattern: str) -> list[str]:
    """The words that one of ``pattern`` stands between its only brackets; plain text but for escaped signs."""
    return [w.replace("\\", "") for w in re.search(r"\(([^()?]+)\)", pattern)[1].split("|")] if "(" in pattern.replace("(?i)", "") else [w.replace("\\", "") for w in pattern.split("|")]


def has_word(text: C, pattern: str, edge: str, low: Column) -> Column:
    """Whether one of a pattern's words stands in a text; most texts hold none of them, so they are sought in the lower-cased text before their edges are looked at."""
    t, found = col(text), F.lit(False)
    for word in _words_of(pattern):
        found |= low.contains(word)
    return found & t.rlike(edged(pattern, edge))


def all_of(text: C, pattern: str) -> Column:
    """Distinct matches, first seen first."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"({pattern})"), F.lit(1)))


def claim_type(text: C, edge: str = EDGE, low: Column | None = None) -> Column:
    """Words end at ``edge``; ``low`` is the lower-cased text, where a column has it."""
    t = col(text)
    low = F.lower(t) if low is None else low
    rest = edge if edge != EDGE else r"\b"
    numbers, percents, amounts = (t.rlike(r"\d") & t.rlike(edged(p, rest)) for p in (NUMBER, PERCENT, AMOUNT))
    out = F.when(F.lit(False), "")
    for name, pattern, _ in CLAIM_TESTS:
        out = out.when(has_word(t, pattern, edge, low), name)
    return out.when(has_word(t, QUANTITY, rest, low) & (numbers | percents), "NUMERICAL").when(has_word(t, FACT, rest, low), "FACTUAL").when(numbers | amounts | percents, "NUMERICAL").otherwise("FACTUAL")


def verifiable(kind: Column) -> Column:
    return ~kind.isin([name for name, _, ok in CLAIM_TESTS if not ok])


def attribution(text: C) -> Column:
    """Who is named as the source of a claim, or null."""
    found = F.trim(F.regexp_extract(col(text), r"(?i)(according to|stated by|claimed by)\s+([^,.]+)", 2))
    low = F.lower(col(text))
    return F.when(low.contains("according to") | low.contains("stated by") | low.contains("claimed by"), F.nullif(found, F.lit("")))


#: Payment handles, hosts of links and phone numbers, and the host that does not count.
PAYMENT_HANDLE = r"(?i)([\w.\-]+@(?:okhdfcbank|okaxis|oksbi|paytm|ybl|upi|apl))"
LINK_HOST = r"(?i)https?://(?:www\.)?([^\s/?]+)"
INDIAN_PHONE = r"((?:\+91|0)?[6-9]\d{9})"
NO_HOST = "example.com"


def campaign_signals(text: C) -> Column:
    """Payment handles, link hosts and phone numbers, in this order."""
    t = col(text)
    pick = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    handles = F.transform(pick(PAYMENT_HANDLE, 1), lambda x: F.concat(F.lit("upi:"), F.lower(x)))
    hosts = F.transform(F.filter(pick(LINK_HOST, 1), lambda x: ~F.lower(x).contains(NO_HOST)), lambda x: F.concat(F.lit("domain:"), F.lower(x)))
    phones = F.transform(pick(INDIAN_PHONE, 1), lambda x: F.concat(F.lit("phone:"), x))
    return F.concat(handles, hosts, phones)


#: Links that leave a query, and words with parts of contact handles or hosts.
QUERY_LINK = r"https?://\S+"
HANDLES = r"(?i)\+91|@okhdfc|@okaxis|@paytm|portal-|\.org|\.com|\.net|\.top"


def search_text(text: C) -> Column:
    """A claim as a query: links removed, white space collapsed; of over eight words the first ten without handles.

    Punctuation stays, as in what is rebuilt here.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), QUERY_LINK, ""), r"[\r\n\t]+", " "), r"\s+", " "))
    words = F.split(clean, " ")
    short = F.array_join(F.slice(F.filter(words, lambda w: ~w.rlike(HANDLES)), 1, 10), " ")
    return F.when(F.size(words) <= 8, clean).otherwise(F.coalesce(F.nullif(short, F.lit("")), clean))


#: How a link's host tells the platform, first match wins.
PLATFORMS = [("reddit", r"reddit\.com"), ("youtube", r"youtube\.com|youtu\.be"), ("instagram", r"instagram\.com"), ("facebook", r"facebook\.com"), ("x", r"x\.com|twitter\.com"), ("linkedin", r"linkedin\.com"), ("tiktok", r"tiktok\.com")]


def platform(url: C) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in PLATFORMS:
        out = out.when(col(url).rlike("(?i)" + pattern), name)
    return out.otherwise("unknown")


def url_host(url: C) -> Column:
    """Lower-case network location of a link with its port, or ``unknown_domain``."""
    found = F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown_domain"))


def url_error(url: C) -> Column:
    """Null for a web link, else what is wrong."""
    u = col(url)
    return F.when(u.isNull() | (u == ""), "Invalid URL.").when(~u.rlike("(?i)^https?:"), "URL must use HTTP/HTTPS.").when(~u.rlike("(?i)^https?://[^/?#]"), "URL must contain a valid domain.")


#: The address of a Reddit post.
REDDIT_POST = r"^(?i:https)://(?i:(?:www\.)?reddit\.com)(?::\d+)?/r/[^/?#]+/comments/[A-Za-z0-9]+(?:/[^/?#]*)?/?(?:[?#].*)?$"


def is_reddit_post(url: C) -> Column:
    return F.coalesce(col(url).rlike(REDDIT_POST), F.lit(False))


#: What the structural features count.
COUNTED = {
    "word_count": r"[^\s\p{Z}]+",
    "upper": r"\p{Lu}",
    "letter": r"\p{L}",
    "digit": r"\p{Nd}",
    "punctuation": r"[!?,.:;\"'()\[\]{}<>\-/\\_@#$%^&*~`]",
    "phone_count": r"(?:\+91[\-\s]?)?[6789]\d{9}|\b\d{10}\b",
    "email_count": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "currency_symbol_count": r"(?i)[₹$€£]|(?:\b(?:rs|inr|usd|eur)\.?\s*\d+)",
}


def text_features(text: C) -> list[Column]:
    """The twelve structural features of a text."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.length(t)
    count = lambda name: F.regexp_count(t, F.lit(COUNTED[name])).cast("long")
    single = lambda c: (n - F.length(F.translate(t, c, ""))).cast("long")  # noqa: E731  one pass, without a pattern
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " ")) != "")).cast("long")
    return [
        n.cast("long").alias("text_length"),
        count("word_count").alias("word_count"),
        F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(sentences, F.lit(1).cast("long"))).alias("sentence_count"),
        ratio(count("upper"), count("letter")).alias("uppercase_ratio"),
        ratio(count("digit"), n).alias("digit_ratio"),
        ratio(count("punctuation"), n).alias("punctuation_ratio"),
        F.regexp_count(t, F.lit(URL)).cast("long").alias("url_count_in_text"),
        count("phone_count").alias("phone_count"),
        count("email_count").alias("email_count"),
        count("currency_symbol_count").alias("currency_symbol_count"),
        single("!").alias("exclamation_count"),
        single("?").alias("question_count"),
    ]
