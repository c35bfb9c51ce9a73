"""Text predicates, normalisation and features as column expressions.

White space means Unicode white space throughout; a null text is an empty one unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and patterns that decide results.
EMPTY_MARKERS = ("", "[deleted]", "[removed]", "nan", "none", "null")
SYNTHETIC_MARKERS = ("lorem ipsum", "test data", "sample text", "synthetic data", "placeholder text")
URL = r"https?://\S+"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2764}\\x{FE0F}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)(\+?\d[\d\-\s()]{7,}\d)(?!\w)"
SECRETS = {
    "api_key": r"(?i)api[_-]?key\s*[:=]",
    "auth_token": r"(?i)\b(access|auth|bearer|refresh)[_-]?token\b",
    "password": r"(?i)\bpassword\b",
    "secret": r"(?i)\bsecret\b",
    "cookie": r"(?i)\bcookie\b",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "google_api_key": r"AIza[0-9A-Za-z_\-]{35}",
    "bearer_header": r"Bearer\s+[A-Za-z0-9\-_.]{10,}",
}
#: First pattern that matches decides the country a text says its author is from.
PLACES = (
    (r"(?i)\b(i'?m|i am|as an?)\s+iranian\b", "IR"),
    (r"(?i)\bi\s+live\s+in\s+iran\b", "IR"),
    (r"(?i)\b(i'?m|i am|as an?)\s+american\b", "US"),
    (r"(?i)\bi\s+live\s+in\s+(the\s+us|the\s+u\.s\.?|america|the\s+united\s+states)\b", "US"),
    ("من\\s+ایرانی(\u200cام|\\s+هستم)?\\b", "IR"),
    ("(ساکن|زندگی\\s+می\u200cکنم\\s+در)\\s+ایران\\b", "IR"),
    ("من\\s+(آمریکایی|امریکایی)(\u200cام|\\s+هستم)?\\b", "US"),
    ("(ساکن|زندگی\\s+می\u200cکنم\\s+در)\\s+(آمریکا|امریکا)\\b", "US"),
    ("أنا\\s+إيراني", "IR"),
    ("أنا\\s+أمريكي", "US"),
)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_present(c: Column) -> Column:
    """Non-null and not blank."""
    return F.coalesce(F.length(stripped(c)) > 0, F.lit(False))


def normalized(c: Column) -> Column:
    return F.lower(stripped(c))


def is_empty_text(c: Column) -> Column:
    return F.coalesce(normalized(c).isin(*EMPTY_MARKERS), F.lit(True))


def is_synthetic(c: Column, markers=SYNTHETIC_MARKERS) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | t.contains(m)
    return out


def is_url_only(c: Column) -> Column:
    """Nothing but URLs; possessive, so no text makes it backtrack."""
    return F.coalesce(stripped(c).rlike(r"(?i)^(?:https?://\S++(?:\s++|$))++$"), F.lit(False))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no expression for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def tidy(c: Column) -> Column:
    """Control and format characters out, runs of blanks to one, ends trimmed. Composed input is the caller's to give (``nfc``)."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    return stripped(F.regexp_replace(t, r"[ \t]+", " "))


def _joined(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.array_join(found, ";"))


def entities(c: Column) -> dict[str, Column]:
    """URLs, mentions, hashtags and distinct emojis, joined by semicolons or null."""
    def every(pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    return {
        "urls_extracted": _joined(every(URL)),
        "mentions_extracted": _joined(every(r"(?U)(?<!\w)@[A-Za-z0-9_]{1,30}")),
        "hashtags_extracted": _joined(every(r"(?U)(?<!\w)#[^\s#]+")),
        "emojis_extracted": _joined(F.array_distinct(every(EMOJI))),
    }


def mask_pii(c: Column) -> tuple[Column, Column]:
    """E-mail addresses, then phone-shaped numbers, to placeholders; and whether there were any."""
    mailed = F.regexp_replace(c, EMAIL, "[EMAIL]")
    return F.regexp_replace(mailed, PHONE, "[PHONE]"), F.coalesce(c.rlike(EMAIL) | mailed.rlike(PHONE), F.lit(False))


def collapse_key(c: Column) -> Column:
    """Lower case with white space collapsed: the key that equal comments share."""
    return F.regexp_replace(normalized(c), r"(?U)\s+", " ")


def loose_key(c: Column) -> Column:
    """As ``collapse_key``, with URLs as one token and punctuation gone."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"https?://\S+|www\.\S+", " <url> ")
    t = F.regexp_replace(t, r"(?U)[^\w\s<>]", " ")
    return stripped(F.regexp_replace(t, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The runs of non-space, in order."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def features(c: Column) -> dict[str, Column]:
    """Characters, words, distinct words, lexical diversity and URL count; words are runs of word characters in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    return {"n_chars": F.char_length(F.coalesce(c, F.lit(""))), "n_words": n, "n_unique_words": distinct, "lexical_diversity": F.round(F.try_divide(distinct.cast("double"), n), 6), "n_urls": F.regexp_count(F.coalesce(c, F.lit("")), F.lit(URL))}


def link_density(c: Column) -> Column:
    """URLs and hashtags, three of them being the most: 0 to 1."""
    t = F.coalesce(c, F.lit(""))
    return F.least(F.lit(1.0), (F.regexp_count(t, F.lit(URL)) + F.regexp_count(t, F.lit(r"#\w+"))) / 3)


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-word shingles in lower case; a shorter text is one shingle, an empty one has none."""
    w = words(F.lower(c))
    # Shifted copies side by side: a lambda that named ``w`` would split the text again for every word.
    shifted = F.arrays_zip(*[F.slice(w, j + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{j}") for j in range(k)])
    runs = F.transform(F.slice(shifted, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x: F.concat_ws(" ", *[x[f"w{j}"] for j in range(k)]))
    whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(w) >= k, runs).otherwise(whole))


def script_language(c: Column) -> Column:
    """fa, ar or en by script: Arabic letters with or without the ones only Persian has."""
    t = F.coalesce(c, F.lit(""))
    return F.when(~t.rlike("[\u0600-\u06ff]"), "en").when(t.rlike("[پچژگی\u200cک]"), "fa").otherwise("ar")


def script_confidence(c: Column) -> Column:
    return F.when(F.length(stripped(F.coalesce(c, F.lit("")))) >= 3, 0.9).otherwise(0.5)


def ratio_language(c: Column) -> tuple[Column, Column]:
    """fa, en or other by the larger count of Arabic-script and Latin letters, with its share."""
    t = F.coalesce(c, F.lit(""))
    fa, en = F.regexp_count(t, F.lit("[\u0600-\u06ff]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    total = fa + en
    lang = F.when(fa > en, "fa").when(en > fa, "en").otherwise("other")
    return lang, F.when(total == 0, 0.0).when(fa == en, 0.5).otherwise(F.round(F.greatest(fa, en) / F.nullif(total, F.lit(0)), 3))


def place(c: Column) -> Column:
    """The country of the first self-identification, or null."""
    out = F.lit(None).cast("string")
    for pattern, country in reversed(PLACES):
        # Unicode classes, so that a word also ends where Persian letters do.
        out = F.when(c.rlike("(?U)" + pattern), country).otherwise(out)
    return out


def geo(c: Column, channel_country: Column, language: Column) -> Column:
    """Struct of method, confidence, granularity and country: the text, else the channel, else nothing."""
    def row(method: str, confidence: str, granularity: str, country: Column) -> Column:
        return F.struct(F.lit(method).alias("geo_method"), F.lit(confidence).alias("geo_confidence"), F.lit(granularity).alias("geo_granularity"), country.alias("country_or_region"), language.alias("language"))

    said = place(F.coalesce(c, F.lit("")))
    return F.when(said.isNotNull(), row("text_place", "medium", "country", said)).when(is_present(channel_country), row("source_community", "low", "country", channel_country)).otherwise(row("language_weak", "low", "unknown", F.lit("unknown")))


def compact_number(c: Column) -> Column:
    """1.2K, 3M, 4B or a plain number as a whole number; else the first digits; else null."""
    t = F.replace(stripped(c), F.lit(","), F.lit(""))
    unit = F.upper(F.substring(t, -1, 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    head = F.when(factor > 1, 1).otherwise(0)
    number = F.substring(t, F.lit(1), F.length(t) - head).try_cast("double")
    first = F.nullif(F.replace(F.regexp_extract(c, r"(\d[\d,]*)", 1), F.lit(","), F.lit("")), F.lit("")).try_cast("long")
    return F.coalesce((number * factor).try_cast("long"), first)


def split_ids(c: Column, separators: str = r"[;,|]\s*") -> Column:
    """Distinct ids of a joined list, sorted."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separators), stripped)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def status_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit(""))


def handle(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^https?://[^/]+/@?([A-Za-z0-9_]{1,30})(?:[/?#]|$)", 1)), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and www off, host in lower case, query, fragment and last slash off."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:www\.)?([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def secret_kinds(c: Column) -> Column:
    """Names of the secret patterns that a text shows, sorted."""
    t = F.coalesce(c, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike(p), name) for name, p in sorted(SECRETS.items())]))


def strip_fences(c: Column) -> Column:
    """A model's answer without its code fences."""
    return stripped(F.regexp_replace(stripped(c), r"^```[A-Za-z]*\s*|\s*```$", ""))


def prompt(template: str, **columns: Column) -> Column:
    """A template's {names} filled with columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def starts_with_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(c.startswith(p), F.lit(False))
    return out
