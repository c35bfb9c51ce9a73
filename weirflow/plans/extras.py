"""Queries over single functions: times, labels and small text rules, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions import dates, text
from weirflow.operators import annotation
from weirflow.plans.texts import T
from weirflow.sources.bindings import table, texts

#: A moment of each event, and the day it is on.
_SECONDS = "1704067200 + event_id * 3607"
_FORMS = {
    "strict": "strftime(moment, '%Y-%m-%dT%H:%M:%SZ')",
    "fraction": "strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.250Z'",
    "seconds": "s::VARCHAR",
    "millis": "(s * 1000)::VARCHAR",
    "naive": "strftime(moment, '%Y-%m-%dT%H:%M:%S')",
    "words": "'yesterday'",
}


def _times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_SECONDS).alias("s"))
    e = e.withColumn("at", F.timestamp_seconds("s")).withColumn("day", F.to_date("at"))
    iso = dates.unix_to_iso(F.col("s"))
    bare = F.substring(iso, 1, 19)
    forms = {"strict": iso, "fraction": F.concat(bare, F.lit(".250Z")), "seconds": F.col("s").cast("string"), "millis": (F.col("s") * 1000).cast("string"), "naive": bare, "words": F.lit("yesterday")}
    form = F.lit(None).cast("string")
    for k, name in enumerate(_FORMS):
        form = F.when(F.col("event_id") % 7 == k, forms[name]).otherwise(form)
    e = e.withColumn("form", form)
    read, status = dates.epoch_or_iso(F.col("form"))
    begin, end = F.date_add("day", F.col("event_id").cast("int") % 3 - 1), F.when(F.col("event_id") % 5 > 0, F.date_add("day", F.col("event_id").cast("int") % 2 - 1))
    return e.select(
        "event_id",
        iso.alias("iso"),
        F.unix_seconds(dates.strict_utc(F.col("form"))).alias("strict_s"),
        F.unix_seconds(dates.lenient_utc(F.when(F.col("event_id") % 7 < 2, F.col("form")))).alias("lenient_s"),
        F.unix_seconds(read).alias("read_s"),
        status.alias("status"),
        dates.is_friday(F.col("day")).alias("is_friday"),
        dates.active_region(F.col("day"), 4).cast("long").alias("region"),
        dates.active_on(F.col("day"), begin, end).alias("is_active"),
        dates.iso_week(F.col("at")).alias("iso_week"),
    )


_FORM = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in enumerate(_FORMS.values())) + " END"
TIMES_SQL = f"""WITH e AS (SELECT event_id, {_SECONDS} AS s, make_timestamp(({_SECONDS}) * 1000000) AS moment FROM events),
f AS (SELECT *, moment::DATE AS day, {_FORM} AS form, event_id % 7 AS k FROM e)
SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN k = 0 THEN s END AS strict_s, CASE WHEN k < 2 THEN s END AS lenient_s, CASE WHEN k < 4 THEN s END AS read_s,
  CASE k WHEN 0 THEN 'iso' WHEN 1 THEN 'iso' WHEN 2 THEN 'epoch_seconds' WHEN 3 THEN 'epoch_millis' WHEN 6 THEN 'missing' ELSE 'unparseable' END AS status,
  dayofweek(day) = 5 AS is_friday, (datediff('day', DATE '0001-01-01', day) + 1) % 4 AS region,
  day + (event_id % 3 - 1)::INT <= day AND (event_id % 5 = 0 OR day <= day + (event_id % 2 - 1)::INT) AS is_active,
  strftime(moment, '%G') || '-W' || strftime(moment, '%V') AS iso_week FROM f"""

_PREFIXES = ("The ", "A ", "Le ")


def _small_rules(t):
    r = F.col("record_id")
    url = F.when(r % 3 == 0, F.concat(F.lit("https://x.com/u/status/"), r.cast("string"), F.lit("?s=1"))).when(r % 3 == 1, F.lit("https://x.com/u"))
    said = F.when(r % 4 == 0, " POS ").when(r % 4 == 1, "خنثی").when(r % 4 == 2, "Mixed").otherwise("great")
    author = F.when(r % 5 == 0, "[deleted]").when(r % 5 == 1, "").when(r % 5 > 2, F.concat(F.lit("a"), r.cast("string")))
    return t.select(
        "record_id",
        text.status_id(url).alias("status_id"),
        annotation.sentiment_alias(said).alias("sentiment"),
        annotation.length_bucket(F.char_length("text")).alias("length_bucket"),
        text.starts_with_any(F.col("text"), _PREFIXES).alias("has_prefix"),
        F.md5(text.prompt("{lang}: {source}!", lang=F.col("lang"), source=F.col("source"))).alias("prompt_md5"),
        text.loose_key(F.concat(F.lit(" See, http://a.b/c?d (now)!  www.e.f "), r.cast("string"), F.lit(" - end."))).alias("loose_key"),
        F.coalesce(text.slug(author), F.lit("-")).alias("author_slug"),
    )


RULES_SQL = f"""{T} SELECT record_id, CASE WHEN record_id % 3 = 0 THEN record_id::VARCHAR END AS status_id,
  CASE record_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'mixed' END AS sentiment,
  CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 150 THEN 'medium' ELSE 'long' END AS length_bucket,
  {' OR '.join(f"starts_with(text, '{p}')" for p in _PREFIXES)} AS has_prefix, md5(lang || ': ' || source || '!') AS prompt_md5,
  'see <url> now <url> ' || record_id || ' end' AS loose_key,
  CASE record_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN '' WHEN 2 THEN '-' ELSE 'a' || record_id END AS author_slug FROM texts"""

QUERIES = {
    "record_times": (_times, TIMES_SQL),
    "small_text_rules": (lambda s, d: _small_rules(texts(s, d)), RULES_SQL),
}
