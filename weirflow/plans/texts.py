"""Queries over raw texts: predicates, features, the funnel, duplicates and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.calendar import PROJECT
from weirflow.functions import ids, text
from weirflow.operators import dedup, funnel, risk
from weirflow.sources.bindings import _pick, table, texts, TEXTS_SQL

T = f"WITH {TEXTS_SQL}"

#: Documents with planted special texts, as the funnel's raw rows.
_TEXT = "CASE WHEN doc_id % 53 = 1 THEN ' [deleted] ' WHEN doc_id % 59 = 1 THEN 'http://a.b/c https://d.e/f' WHEN doc_id % 61 = 1 THEN 'Lorem Ipsum here' WHEN doc_id % 71 = 1 THEN 'just some Test Data here' WHEN doc_id % 73 = 1 THEN 'a sample text and synthetic data' WHEN doc_id % 67 = 1 THEN NULL ELSE text END"
RAW = {
    "platform": "CASE WHEN doc_id % 41 = 2 THEN 'facebook' WHEN doc_id % 7 = 1 THEN ' X ' ELSE " + _pick("doc_id % 3", ("x", "reddit", "youtube")) + " END",
    "platform_content_id": "CASE WHEN doc_id % 17 = 3 THEN NULL ELSE concat('c', cast(doc_id % 900 as string)) END",
    "record_uid": "CASE WHEN doc_id % 34 = 3 THEN NULL ELSE concat('r', cast(doc_id as string)) END",
    "original_row_number": "doc_id",
    "matched_query_ids": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Q', cast(doc_id % 3 as string), ';Q', cast(doc_id % 4 as string)) END",
    "timestamp_origin": "CASE WHEN doc_id % 43 = 4 THEN 'unknown' ELSE 'native' END",
    "content_type": _pick("doc_id % 10", ("comment", "reply", "original_post", "quote", "repost", "video_context", "deleted_or_unavailable", "comment", "poll", "unknown")),
    "content_status": "CASE WHEN doc_id % 47 = 5 THEN 'removed' ELSE 'live' END",
    "text_raw": _TEXT,
    "provenance_quality": "CASE WHEN doc_id % 6 = 0 THEN 'complete' WHEN doc_id % 6 = 1 THEN 'partial' END",
    "collection_run_id": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'run1' END",
    "original_file_name": "CASE WHEN doc_id % 9 = 3 THEN NULL ELSE 'file1' END",
    "original_file_sha256": "CASE WHEN doc_id % 18 = 3 THEN 'ab12' END",
    "query_id": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Q1' END",
    "source_id": "source",
}


def raw_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    created = F.expr("CASE WHEN doc_id % 19 = 7 THEN NULL ELSE timestamp'2024-01-01' + make_dt_interval(cast(doc_id % 40 as int)) END")
    return d.select(*[F.expr(e).alias(c) for c, e in RAW.items()], created.alias("created_at"), F.expr("timestamp'2024-03-01' + make_dt_interval(cast(doc_id % 5 as int))").alias("collected_at"))


RAW_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + ", CASE WHEN doc_id % 19 = 7 THEN NULL ELSE timestamp '2024-01-01' + to_days((doc_id % 40)::INT) END AS created_at, timestamp '2024-03-01' + to_days((doc_id % 5)::INT) AS collected_at FROM documents)"
_STRIP = r"regexp_replace({c}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
STRIP = lambda c: _STRIP.format(c=c)
_EMPTY = f"(text_raw IS NULL OR lower({STRIP('text_raw')}) IN ('', '[deleted]', '[removed]', 'nan', 'none', 'null'))"
FUNNEL_SQL = f"""WITH {RAW_SQL},
k AS (SELECT *, CASE WHEN platform_content_id IS NOT NULL THEN lower(platform) || '::' || platform_content_id WHEN record_uid IS NOT NULL THEN 'uid::' || record_uid ELSE 'none::' || original_row_number END AS k FROM raw),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY collected_at NULLS LAST, original_row_number NULLS LAST, record_uid NULLS LAST) AS rn,
 array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN matched_query_ids IS NULL THEN []::VARCHAR[] ELSE string_split(matched_query_ids, ';') END) OVER (PARTITION BY k)))), ';') AS merged FROM k),
f AS (SELECT *, lower({STRIP('platform')}) AS p, {_EMPTY} AS empty, created_at IS NULL OR timestamp_origin = 'unknown' AS untimed, {PROJECT.week_sql('created_at')} AS project_week,
 provenance_quality IS NULL AND collection_run_id IS NULL AND original_file_name IS NULL AND original_file_sha256 IS NULL AS not_auditable,
 CASE WHEN provenance_quality IS NOT NULL THEN provenance_quality WHEN collection_run_id IS NULL AND original_file_name IS NULL AND original_file_sha256 IS NULL THEN 'unknown' WHEN collection_run_id IS NOT NULL AND query_id IS NOT NULL AND source_id IS NOT NULL THEN 'complete' ELSE 'partial' END AS q FROM w),
d AS (SELECT *, CASE WHEN p NOT IN ('x', 'reddit', 'youtube') THEN 'quarantine|raw_validation|other_documented' WHEN platform_content_id IS NULL AND record_uid IS NULL THEN 'quarantine|raw_validation|missing_content_id'
 WHEN rn > 1 THEN 'quarantine|dedup|duplicate_exact_id' WHEN NOT untimed AND project_week = 'OUT' THEN 'quarantine|date_rule|out_of_window'
 WHEN content_type = 'deleted_or_unavailable' OR content_status IN ('deleted', 'removed') THEN 'audit_only|text|deleted_or_removed' WHEN content_type = 'poll' THEN 'quarantine|text|invalid_content_type'
 WHEN NOT (content_type IN ('video_context', 'repost') OR (p = 'reddit' AND content_type = 'original_post' AND empty)) AND empty THEN 'quarantine|text|empty_text' WHEN not_auditable THEN 'quarantine|provenance|invalid_provenance'
 WHEN regexp_matches(lower(coalesce(text_raw, '')), 'lorem ipsum|test data|sample text|synthetic data|placeholder text') THEN 'quarantine|topic|synthetic_or_test' WHEN query_id IS NULL AND matched_query_ids IS NULL AND regexp_full_match({STRIP("coalesce(text_raw, '')")}, '(?i)(https?://\\S+\\s*)+') THEN 'quarantine|topic|out_of_scope'
 WHEN content_type = 'video_context' THEN 'context_only|role|' WHEN content_type = 'repost' THEN 'audit_only|role|repost_only' WHEN p = 'reddit' AND content_type = 'original_post' AND empty THEN 'context_only|role|'
 WHEN untimed THEN 'opinion_untimed|role|' WHEN q = 'partial' THEN 'opinion_limited|role|' ELSE 'opinion_main|role|' END AS v FROM f),
o AS (SELECT *, string_split(v, '|')[1] AS dataset_target, string_split(v, '|')[2] AS stage, nullif(string_split(v, '|')[3], '') AS reason,
 concat_ws(';', CASE WHEN platform_content_id IS NULL AND record_uid IS NOT NULL THEN 'surrogate_id_only' END, CASE WHEN q = 'partial' THEN 'limited_provenance' END, CASE WHEN untimed THEN 'missing_timestamp' END) AS flags,
 CASE WHEN rn > 1 THEN matched_query_ids ELSE merged END AS merged_query_ids FROM d)"""
_AUDIT = "record_uid, platform, platform_content_id, dataset_target, stage, reason, CASE WHEN stage = 'role' AND dataset_target LIKE 'opinion%' AND flags <> '' THEN flags END AS secondary_reasons, q AS provenance_assessed, project_week, merged_query_ids"


def _texts(f):
    return lambda spark, sf_dir: f(texts(spark, sf_dir))


def _flags(t):
    x = F.when(F.col("record_id") % 11 == 0, F.lit(" [Removed]\n")).when(F.col("record_id") % 13 == 0, F.lit("https://a.b/c http://d")).when(F.col("record_id") % 17 == 0, F.lit("A Lorem IPSUM")).when(F.col("record_id") % 19 == 0, F.lit("just some test data here")).when(F.col("record_id") % 23 == 0, F.lit("Sample TEXT")).when(F.col("record_id") % 29 == 0, F.lit("synthetic data")).when(F.col("record_id") % 31 == 0, F.lit("a placeholder text")).otherwise(F.col("text"))
    return t.select("record_id", text.is_present(x).alias("present"), text.is_empty_text(x).alias("empty"), text.is_synthetic(x).alias("synthetic"), text.is_url_only(x).alias("url_only"))


_X = "CASE WHEN record_id % 11 = 0 THEN ' [Removed]\n' WHEN record_id % 13 = 0 THEN 'https://a.b/c http://d' WHEN record_id % 17 = 0 THEN 'A Lorem IPSUM' WHEN record_id % 19 = 0 THEN 'just some test data here' WHEN record_id % 23 = 0 THEN 'Sample TEXT' WHEN record_id % 29 = 0 THEN 'synthetic data' WHEN record_id % 31 = 0 THEN 'a placeholder text' ELSE text END"
FLAGS_SQL = f"{T}, x AS (SELECT record_id, {_X} AS x FROM texts) SELECT record_id, coalesce(length({STRIP('x')}) > 0, false) AS present, coalesce(lower({STRIP('x')}) IN ('', '[deleted]', '[removed]', 'nan', 'none', 'null'), true) AS empty, regexp_matches(lower(x), 'lorem ipsum|test data|sample text|synthetic data|placeholder text') AS synthetic, regexp_full_match({STRIP('x')}, '(?i)(https?://\\S+\\s*)+') AS url_only FROM x"


def _normalized(t):
    x = text.tidy(text.nfc(F.col("text")))
    return t.select("record_id", F.md5(x.cast("binary")).alias("text_md5"), F.char_length(x).alias("text_length"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}]', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
NORMALIZED_SQL = f"{T} SELECT record_id, md5({_CLEAN}) AS text_md5, length({_CLEAN})::INT AS text_length FROM texts"


def _planted(c="text"):
    return F.concat(F.lit("See https://t.co/a "), F.when(F.col("record_id") % 5 == 0, F.lit("@user_1 #Tag ☀☀ \u2764\ufe0f ")).otherwise(F.lit("")), F.col(c))


_PLANT = "concat('See https://t.co/a ', CASE WHEN record_id % 5 = 0 THEN '@user_1 #Tag ☀☀ \u2764\ufe0f ' ELSE '' END, text)"


def _entities(t):
    return t.select("record_id", *[F.md5(F.coalesce(e, F.lit("-")).cast("binary")).alias(n) for n, e in text.entities(_planted()).items()])


def _every(p: str, group: int = 0, distinct: bool = False) -> str:
    found = f"regexp_extract_all(x, '{p}', {group})"
    found = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({found}, lambda v: [v])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)" if distinct else found
    return f"md5(coalesce(nullif(array_to_string({found}, ';'), ''), '-'))"


ENTITIES_SQL = f"{T}, p AS (SELECT record_id, {_PLANT} AS x FROM texts) SELECT record_id, {_every('https?://[^ \\t\\n\\r\\f\\v]+')} AS urls_extracted, {_every('(^|[^\\p{L}\\p{N}\\p{M}_])(@[A-Za-z0-9_]{1,30})', 2)} AS mentions_extracted, {_every('(^|[^\\p{L}\\p{N}\\p{M}_])(#[^ \\t\\n\\r\\f\\v#]+)', 2)} AS hashtags_extracted, {_every('[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2764}\\x{FE0F}]', 0, True)} AS emojis_extracted FROM p"


def _pii(t):
    masked, found = text.mask_pii(F.col("text"))
    return t.select("record_id", F.regexp_replace("text", text.EMAIL, "[EMAIL]").alias("m"), found.alias("pii_masked"), masked.alias("f")).select("record_id", F.md5(F.col("m").cast("binary")).alias("mail_masked_md5"), F.col("m").contains("[EMAIL]").alias("has_email"))


PII_SQL = f"{T}, m AS (SELECT record_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') AS m FROM texts) SELECT record_id, md5(m) AS mail_masked_md5, contains(m, '[EMAIL]') AS has_email FROM m"


def _pii_full(t):
    masked, found = text.mask_pii(F.col("text"))
    return t.select("platform", found.alias("found"), F.char_length(masked).alias("n")).groupBy("platform").agg(F.count_if("found").alias("n_with_pii"), F.sum("n").alias("n_chars_masked"))


def _features(t):
    return t.select("record_id", *[c.alias(n) for n, c in text.features(F.col("text")).items()], F.round(text.link_density(_planted()), 6).alias("link_density"), F.size(text.shingles(F.col("text"))).alias("n_shingles"))


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_\p{Pc}]+')"
_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
FEATURES_SQL = f"""{T}, w AS (SELECT *, {_W} AS w, {_SPLIT} AS s, {_PLANT} AS x FROM texts)
SELECT record_id, length(text)::INT AS n_chars, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_unique_words, round(len(list_distinct(w)) * 1.0e0 / nullif(len(w), 0), 6) AS lexical_diversity, len(regexp_extract_all(text, 'https?://\\S+'))::INT AS n_urls,
 round(least(1.0e0, (len(regexp_extract_all(x, 'https?://\\S+')) + len(regexp_extract_all(x, '#\\w+'))) / 3.0e0), 6) AS link_density,
 (CASE WHEN len(s) >= 3 THEN len(list_distinct(list_transform(range(1, len(s) - 1), lambda i: array_to_string(list_slice(s, i, i + 2), ' ')))) WHEN len(s) > 0 THEN 1 ELSE 0 END)::INT AS n_shingles FROM w"""


def _language(t):
    x = F.when(F.col("record_id") % 7 == 0, F.lit("من ایرانی هستم و پیام")).when(F.col("record_id") % 11 == 0, F.lit("سلام")).when(F.col("record_id") % 13 == 0, F.lit("من ایرانیان را")).when(F.col("record_id") % 17 == 0, F.lit("so I live in America, he said")).otherwise(F.col("text"))
    lang, share = text.ratio_language(x)
    g = text.geo(x, F.when(F.col("record_id") % 3 == 0, "DE"), text.script_language(x))
    return t.select("record_id", text.script_language(x).alias("script_language"), text.script_confidence(x).alias("script_confidence"), lang.alias("ratio_language"), share.alias("ratio_share"), g["geo_method"].alias("geo_method"), g["country_or_region"].alias("country_or_region"))


LANGUAGE_SQL = f"""{T}, x AS (SELECT record_id, CASE WHEN record_id % 7 = 0 THEN 'من ایرانی هستم و پیام' WHEN record_id % 11 = 0 THEN 'سلام' WHEN record_id % 13 = 0 THEN 'من ایرانیان را' WHEN record_id % 17 = 0 THEN 'so I live in America, he said' ELSE text END AS x FROM texts),
c AS (SELECT *, len(regexp_extract_all(x, '[\\x{{0600}}-\\x{{06FF}}]')) AS fa, len(regexp_extract_all(x, '[A-Za-z]')) AS en, CASE WHEN regexp_matches(x, 'من\\s+ایرانی(\\x{{200C}}ام|\\s+هستم)?([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') THEN 'IR' WHEN regexp_matches(x, '(?i)\\bi\\s+live\\s+in\\s+(the\\s+us|the\\s+u\\.s\\.?|america|the\\s+united\\s+states)\\b') THEN 'US' END AS said FROM x)
SELECT record_id, CASE WHEN fa = 0 THEN 'en' WHEN regexp_matches(x, '[پچژگی‌ک]') THEN 'fa' ELSE 'ar' END AS script_language, CASE WHEN length({STRIP('x')}) >= 3 THEN 0.9e0 ELSE 0.5e0 END AS script_confidence,
 CASE WHEN fa > en THEN 'fa' WHEN en > fa THEN 'en' ELSE 'other' END AS ratio_language, CASE WHEN fa + en = 0 THEN 0.0e0 WHEN fa = en THEN 0.5e0 ELSE round(greatest(fa, en) * 1.0e0 / (fa + en), 3) END AS ratio_share,
 CASE WHEN said IS NOT NULL THEN 'text_place' WHEN record_id % 3 = 0 THEN 'source_community' ELSE 'language_weak' END AS geo_method, CASE WHEN said IS NOT NULL THEN said WHEN record_id % 3 = 0 THEN 'DE' ELSE 'unknown' END AS country_or_region FROM c"""


def _ids(t):
    r = F.col("record_id").cast("string")
    native = F.when(F.col("record_id") % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), r))
    uid = ids.record_uid(F.col("platform"), F.col("source"), F.col("record_id"))
    return t.select("record_id", ids.author_hash(F.col("platform"), native, "pepper").alias("author_hash"), uid.alias("record_uid"), ids.content_id(native, uid).alias("content_id"), ids.derived_id(r, F.col("text")).alias("derived_id"), ids.row_hash({"b": F.col("lang"), "a": r}).alias("row_hash"), ids.cache_key(r, F.col("lang")).alias("cache_key"), ids.job_id(F.col("platform"), r).alias("job_id"))


IDS_SQL = f"""{T}, n AS (SELECT *, CASE WHEN record_id % 6 = 0 THEN NULL ELSE 'n' || record_id END AS native, sha256(platform || ':' || source || ':' || record_id) AS uid FROM texts)
SELECT record_id, CASE WHEN native IS NOT NULL THEN sha256(platform || ':' || native || ':pepper') END AS author_hash, uid AS record_uid, coalesce(native, 'uid::' || uid) AS content_id, 'derived:' || record_id || ':' || substr(sha1(text), 1, 12) AS derived_id,
 sha1('a=' || record_id || chr(31) || 'b=' || lang) AS row_hash, sha256(record_id || chr(0) || lang || chr(0)) AS cache_key, platform || '|' || record_id AS job_id FROM n"""


def _urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    compact = F.concat((F.col("page_id") % 97).cast("string"), F.when(F.col("page_id") % 4 == 0, F.lit(".5K")).when(F.col("page_id") % 4 == 1, F.lit("M")).otherwise(F.lit(",000")))
    return p.select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"), ids.permalink_hash(F.col("url")).alias("permalink_hash"), text.handle(F.col("url")).alias("handle"), text.compact_number(compact).alias("metric"), F.array_join(text.secret_kinds(F.concat(F.lit("password cookie "), "url")), ";").alias("secrets"), text.slug(F.col("url")).alias("slug"))


URLS_SQL = r"""SELECT page_id, 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://(?:www\.)?([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical_url, sha256(url) AS permalink_hash,
 nullif(lower(regexp_extract(url, '^https?://[^/]+/@?([A-Za-z0-9_]{1,30})(?:[/?#]|$)', 1)), '') AS handle,
 CASE page_id % 4 WHEN 0 THEN (page_id % 97) * 1000 + 500 WHEN 1 THEN (page_id % 97) * 1000000 ELSE (page_id % 97) * 1000 END AS metric, 'cookie;password' AS secrets,
 regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages"""

GROUPS_SQL = f"""{T}, h AS (SELECT *, CASE WHEN length(text) >= 10 THEN substr(sha1(lower({STRIP('text')})), 1, 16) END AS h FROM texts), g AS (SELECT h, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1)
SELECT record_id, g.h IS NOT NULL AS duplicate_text_diff_id, 'txt_' || g.h AS duplicate_text_group_id FROM h LEFT JOIN g USING (h)"""

NEAR_SQL = f"""{T.replace('WITH ', 'WITH RECURSIVE ')}, w AS (SELECT *, {_SPLIT} AS s FROM texts),
s AS (SELECT record_id, platform, week_no, CASE WHEN len(s) >= 3 THEN list_distinct(list_transform(range(1, len(s) - 1), lambda i: array_to_string(list_slice(s, i, i + 2), ' '))) WHEN len(s) > 0 THEN [array_to_string(s, ' ')] ELSE [] END AS s FROM w WHERE length(text) >= 10),
e AS (SELECT record_id, platform, week_no, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.record_id AS u, b.record_id AS v FROM e a JOIN e b ON a.x = b.x AND a.platform = b.platform AND a.week_no = b.week_no AND a.record_id <> b.record_id GROUP BY a.record_id, b.record_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
r AS (SELECT u AS v, u AS c FROM l UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.v), c AS (SELECT v AS record_id, min(c) AS c FROM r GROUP BY v),
nm AS (SELECT t.record_id AS c, 'nd_' || platform || '_' || week_no || '_' || lpad(row_number() OVER (PARTITION BY platform, week_no ORDER BY t.record_id)::VARCHAR, 3, '0') AS name FROM texts t WHERE t.record_id IN (SELECT c FROM c)),
near AS (SELECT record_id, platform, week_no, name AS near_duplicate_cluster_id, c IS NOT NULL AS is_near_duplicate FROM texts LEFT JOIN c USING (record_id) LEFT JOIN nm USING (c))"""
NEAR_STATS_SQL = f"""{NEAR_SQL}, p AS (SELECT platform, week_no, near_duplicate_cluster_id AS c, count(*) AS n FROM near GROUP BY ALL)
SELECT platform, week_no, sum(n)::BIGINT AS n_rows, count(c) AS n_clusters, coalesce(sum(n) FILTER (WHERE c IS NOT NULL), 0)::BIGINT AS n_clustered, coalesce(max(n) FILTER (WHERE c IS NOT NULL), 0) AS largest_cluster FROM p GROUP BY platform, week_no"""

#: Comments from events: a batch is a post, an author a user.
COMMENT = {"content_id": "event_id", "batch": "concat('b', cast(event_id % 20 as string))", "author": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('u', cast(user_id % 40 as string)) END", "post_id": "concat('p', cast(event_id % 60 as string))", "is_reply": "event_id % 3 = 0", "text": "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 4 = 0 THEN concat('Same  text ', event_type) WHEN event_id % 5 = 0 THEN concat('see https://a.b/', cast(event_id as string), ' #tag #more') ELSE concat('note ', cast(event_id as string)) END", "likes": "cast(event_id % 9 as double)", "parent_comment_id": "CASE WHEN event_id % 3 = 0 AND event_id > 10 THEN event_id - event_id % 10 - 1 END"}
#: Times are packed so that bursts happen.
_TS = "timestamp_seconds(1704067200 + (event_id div 4) * 20)"
COMMENTS_SQL = "comments AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COMMENT.items()) + ", 1704067200 + (event_id // 4) * 20 AS t FROM events)"
_KEY = r"regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
RISK_CTE = f"""WITH {COMMENTS_SQL}, k AS (SELECT *, {_KEY.format(c='text')} AS k FROM comments),
s AS (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY batch, k) END AS same, list(t) OVER (PARTITION BY batch, author ORDER BY t, content_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM k),
r AS (SELECT *, least(1.0e0, (same - 1) / 4.0e0) AS duplicate_score, CASE WHEN author IS NULL THEN 0.0e0 ELSE (len(list_filter(near, lambda x: t - x <= 60)) - 1) / 3.0e0 END AS burst_score, least(1.0e0, (len(regexp_extract_all(coalesce(text, ''), 'https?://\\S+')) + len(regexp_extract_all(coalesce(text, ''), '#\\w+'))) / 3.0e0) AS link_score FROM s),
scored AS (SELECT *, round(round(least(1.0e0, 0.5e0 * duplicate_score + 0.35e0 * burst_score + 0.15e0 * link_score), 10), 4) AS automation_risk_score FROM r)"""
RISK_SQL = f"{RISK_CTE} SELECT content_id, round(duplicate_score, 6) AS duplicate_score, round(burst_score, 6) AS burst_score, round(link_score, 6) AS link_score, automation_risk_score FROM scored"


def comments(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in COMMENT.items()], F.expr(_TS).alias("ts"))


def _risk(spark, sf_dir):
    r = risk.comment_risk(comments(spark, sf_dir))
    return r.select("content_id", *[F.round(c, 6).alias(c) for c in ("duplicate_score", "burst_score", "link_score")], "automation_risk_score")


_USER = ("author", "total_interactions", "posts_participated", "replies", "reply_ratio", "mean_word_count", "median_word_count", "mean_like_count", "url_interaction_ratio", "exact_duplicate_ratio", "unique_text_ratio", "median_interarrival_seconds", "rapid_activity_ratio_60s", "active_utc_hours", "hour_coverage_ratio", "mean_comment_level_automation_risk", "automation_risk_score_user", "is_flagged_bot_suspect")


def _users(spark, sf_dir):
    return risk.user_features(risk.comment_risk(comments(spark, sf_dir))).select(*_USER)


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))"
USERS_CTE = f"""{RISK_CTE}, u0 AS (SELECT *, t - lag(t) OVER (PARTITION BY author ORDER BY t, content_id) AS gap, CASE WHEN k IS NULL THEN 0 ELSE count(k) OVER (PARTITION BY author, k) END AS mine FROM scored WHERE author IS NOT NULL),
u1 AS (SELECT author, count(*) AS total_interactions, count(DISTINCT post_id) AS posts_participated, count(*) FILTER (WHERE is_reply) AS replies, round(avg(is_reply::INT), 4) AS reply_ratio, round(avg({_WORDS}), 2) AS mean_word_count, quantile_cont({_WORDS}, 0.5)::DOUBLE AS median_word_count, round(avg(likes), 2) AS mean_like_count,
 round(avg(coalesce(regexp_matches(text, 'https?://\\S+'), false)::INT), 4) AS url_interaction_ratio, round(count(*) FILTER (WHERE mine > 1) * 1.0e0 / count(k), 4) AS exact_duplicate_ratio, round(count(DISTINCT k) * 1.0e0 / count(k), 4) AS unique_text_ratio, quantile_cont(gap, 0.5)::DOUBLE AS median_interarrival_seconds,
 round(coalesce(count(*) FILTER (WHERE gap <= 60) * 1.0e0 / nullif(count(gap), 0), 0), 4) AS rapid_activity_ratio_60s, count(DISTINCT (t % 86400) // 3600) AS active_utc_hours, round(count(DISTINCT (t % 86400) // 3600) / 24.0e0, 4) AS hour_coverage_ratio, floor((2 * sum(round(automation_risk_score * 10000)::BIGINT) + count(*)) // (2 * count(*))) / 10000.0e0 AS mean_comment_level_automation_risk FROM u0 GROUP BY author),
users AS (SELECT *, (least(1000000, 35 * round(exact_duplicate_ratio * 10000)::BIGINT + 25 * round(rapid_activity_ratio_60s * 10000)::BIGINT + 15 * round(url_interaction_ratio * 10000)::BIGINT + 10 * round(hour_coverage_ratio * 10000)::BIGINT + 15 * round(mean_comment_level_automation_risk * 10000)::BIGINT) + 50) // 100 / 10000.0e0 AS automation_risk_score_user FROM u1)"""
USERS_SQL = f"{USERS_CTE} SELECT *, automation_risk_score_user >= 0.7 AS is_flagged_bot_suspect FROM users"


def _rule_users(spark, sf_dir):
    c = risk.response_times(comments(spark, sf_dir))
    low = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b\w+\b"), F.lit(0))
    div = F.try_divide(F.size(F.array_distinct(low)).cast("double"), F.size(low))
    extra = c.filter("author IS NOT NULL").groupBy("author").agg(F.percentile(F.when(F.col("is_reply"), F.col("response_seconds")), F.lit(0.5)).alias("median_response_time_seconds"), F.coalesce(F.try_divide(F.count_if(F.col("is_reply") & (F.col("response_seconds") <= 60)).cast("double"), F.count_if("is_reply")), F.lit(0.0)).alias("very_fast_reply_ratio_60s"), F.coalesce(F.try_divide(F.count_if("is_self_reply").cast("double"), F.count_if("is_reply")), F.lit(0.0)).alias("self_reply_ratio"), F.avg(div).alias("mean_lexical_diversity"))
    return _users(spark, sf_dir).join(extra, "author").withColumnRenamed("author", "user_key")


_DIV = r"len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\w+'))) * 1.0e0 / nullif(len(regexp_extract_all(lower(coalesce(text, '')), '\w+')), 0)"
RULE_CTE = f"""{USERS_CTE}, rt AS (SELECT c.*, c.t - p.t AS resp, coalesce(c.author = p.author, false) AS own FROM comments c LEFT JOIN comments p ON p.content_id = c.parent_comment_id),
x AS (SELECT author, quantile_cont(resp, 0.5) FILTER (WHERE is_reply) AS med, coalesce(count(*) FILTER (WHERE is_reply AND resp <= 60) * 1.0e0 / nullif(count(*) FILTER (WHERE is_reply), 0), 0) AS fast, coalesce(count(*) FILTER (WHERE own) * 1.0e0 / nullif(count(*) FILTER (WHERE is_reply), 0), 0) AS self, avg({_DIV}) AS div FROM rt WHERE author IS NOT NULL GROUP BY author),
y AS (SELECT author AS user_key, * EXCLUDE (author), (SELECT quantile_cont(div, 0.1) FROM x) AS q10, (SELECT quantile_cont(div, 0.5) FROM x) AS q50, count(*) OVER () AS nn, rank() OVER (ORDER BY posts_participated) + (count(*) OVER (PARTITION BY posts_participated) - 1) / 2.0e0 AS rk FROM users JOIN x USING (author)),
z AS (SELECT *, 0.7e0 * exact_duplicate_ratio + 0.3e0 * (1 - unique_text_ratio) AS duplicate_score, CASE WHEN replies = 0 THEN 0.0e0 ELSE 0.7e0 * fast + 0.3e0 * (1 - least(greatest(coalesce(med, 3600.0e0), 0), 3600.0e0) / 3600.0e0) END AS fast_reply_score,
 CASE WHEN total_interactions <= 1 THEN 0.0e0 ELSE 1 - least(greatest(coalesce(median_interarrival_seconds, 3600.0e0), 0), 3600.0e0) / 3600.0e0 END AS rapid_activity_score, hour_coverage_ratio * least(1.0e0, total_interactions / 20.0e0) AS continuous_activity_score, url_interaction_ratio AS url_score,
 greatest(0.0e0, least(1.0e0, (q50 - div) / greatest(q50 - q10, 1e-9))) AS low_diversity_score, least(1.0e0, self) AS self_reply_score, least(1.0e0, rk / nn) AS multi_post_activity_score FROM y),
rule AS (SELECT *, least(100.0e0, greatest(0.0e0, 25 * duplicate_score + 15 * fast_reply_score + 15 * rapid_activity_score + 10 * continuous_activity_score + 10 * url_score + 10 * low_diversity_score + 5 * self_reply_score + 10 * multi_post_activity_score)) AS raw FROM z),
ruled AS (SELECT *, round(raw, 6) AS rule_score FROM rule)"""
_PARTS = ("duplicate_score", "fast_reply_score", "rapid_activity_score", "continuous_activity_score", "url_score", "low_diversity_score", "self_reply_score", "multi_post_activity_score")
_GROUP = "CASE WHEN rule_score <= 20 THEN 'low_risk' WHEN rule_score <= 50 THEN 'review_low' WHEN rule_score <= 75 THEN 'review_high' ELSE 'high_risk' END"
RULE_SQL = f"""{RULE_CTE} SELECT user_key, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)}, rule_score, {_GROUP} AS rule_risk_group, CASE WHEN total_interactions <= 2 THEN 'insufficient' WHEN total_interactions <= 4 THEN 'low' WHEN total_interactions <= 9 THEN 'medium' ELSE 'high' END AS evidence_level, CASE WHEN total_interactions >= 3 THEN {_GROUP} ELSE 'insufficient_evidence' END AS final_rule_status FROM ruled"""
REVIEW_SQL = f"""{RULE_CTE}, m AS (SELECT quantile_cont(rule_score, 0.5) AS m FROM ruled), a AS (SELECT 'highest' AS sample, user_key, rule_score FROM ruled ORDER BY rule_score DESC, user_key LIMIT 10), b AS (SELECT 'lowest' AS sample, user_key, rule_score FROM ruled ORDER BY rule_score, user_key LIMIT 10),
c AS (SELECT 'median' AS sample, user_key, rule_score FROM ruled, m ORDER BY abs(rule_score - m), user_key LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""

QUERIES = {
    "text_predicates": (_texts(_flags), FLAGS_SQL),
    "text_normalized": (_texts(_normalized), NORMALIZED_SQL),
    "text_entities": (_texts(_entities), ENTITIES_SQL),
    "text_mail_masking": (_texts(_pii), PII_SQL),
    "text_pii_masking": (_texts(_pii_full), None),
    "text_features": (_texts(_features), FEATURES_SQL),
    "text_language_geo": (_texts(_language), LANGUAGE_SQL),
    "record_ids": (_texts(_ids), IDS_SQL),
    "page_urls": (_urls, URLS_SQL),
    "eligibility_funnel": (lambda s, d: funnel.audit_trail(funnel.decide(raw_records(s, d))), f"{FUNNEL_SQL} SELECT {_AUDIT} FROM o"),
    "eligibility_reconciliation": (lambda s, d: funnel.reconciliation(funnel.decide(raw_records(s, d))), f"{FUNNEL_SQL} SELECT dataset_target, platform, reason, count(*) AS n FROM o GROUP BY ALL"),
    "text_duplicate_groups": (_texts(lambda t: dedup.text_groups(t).select("record_id", "duplicate_text_diff_id", "duplicate_text_group_id")), GROUPS_SQL),
    "near_duplicate_clusters": (_texts(dedup.near_clusters), f"{NEAR_SQL} SELECT * FROM near"),
    "near_duplicate_statistics": (_texts(lambda t: dedup.near_statistics(dedup.near_clusters(t))), NEAR_STATS_SQL),
    "comment_risk": (_risk, RISK_SQL),
    "user_risk": (_users, USERS_SQL),
    "user_rule_score": (lambda s, d: risk.rule_score(_rule_users(s, d)), RULE_SQL),
    "user_review_samples": (lambda s, d: risk.review_samples(risk.rule_score(_rule_users(s, d)), 10), REVIEW_SQL),
}
