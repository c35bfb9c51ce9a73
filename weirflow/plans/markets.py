"""Queries over market series, label quality, samples and audits, with SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weirflow.calendar import PROJECT
from weirflow.operators import annotation, battery, dedup, finance, inference, quality, sampling
from weirflow.plans.weekly import BASE
from weirflow.sources.bindings import ASSETS_SQL, LABEL_AXES, PLATFORMS, RECORDS_SQL, SENTIMENTS, TEXTS_SQL, assets, records, table, texts

#: The first project day; no order is older.
START = "1995-01-01"
NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
A = f"WITH {ASSETS_SQL}"
CH = f"{A}, k AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS c, min(value) OVER (PARTITION BY asset_id) AS lo FROM assets WHERE value IS NOT NULL), ch AS (SELECT observation_date, asset_id, value, CASE WHEN c < 3 THEN 'none' WHEN lo > 0 THEN 'log_return' ELSE 'first_difference' END AS transform, CASE WHEN c < 3 THEN NULL WHEN lo > 0 THEN ln(value) - lag(ln(value)) OVER w ELSE value - lag(value) OVER w END AS change FROM k WINDOW w AS (PARTITION BY asset_id ORDER BY observation_date))"
WEEK = f"(datediff('day', DATE '{START}', observation_date) // 7 + 1)"
DAY = "CAST(observation_date AS VARCHAR) AS observation_date"
PANEL = f"""{A}, e AS (SELECT min(observation_date) AS a, max(observation_date) AS b FROM assets), days AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS observation_date FROM e), nm AS (SELECT asset_id, min(observation_date) AS f, max(observation_date) AS l FROM assets GROUP BY 1), od AS (SELECT DISTINCT observation_date, true AS op FROM assets),
panel AS (SELECT observation_date, asset_id, value, CASE WHEN value IS NOT NULL THEN 'observed' WHEN dayofweek(observation_date) = 5 THEN 'friday' WHEN op IS NULL THEN 'market_closed' WHEN observation_date < f THEN 'before_first' WHEN observation_date > l THEN 'after_last' ELSE 'missing' END AS reason, op IS NOT NULL AS market_open FROM days CROSS JOIN nm LEFT JOIN od USING (observation_date) LEFT JOIN assets USING (observation_date, asset_id)),
cov AS (SELECT {WEEK} AS week, asset_id, count(*) FILTER (WHERE market_open) AS open_days, count(value) AS observed_days, array_to_string(list_sort(list_distinct(list(reason))), '|') AS reasons FROM panel GROUP BY ALL),
covr AS (SELECT week, asset_id, open_days, observed_days, round(observed_days * 1.0e0 / nullif(open_days, 0), 6) AS coverage_ratio, reasons, CASE WHEN open_days = 0 THEN 'market_closed' WHEN observed_days = 0 THEN 'no_data' WHEN observed_days * 1.0e0 / open_days < 0.6 THEN 'partial' ELSE 'ok' END AS status FROM cov)"""


def _a(f, *args, **kw):
    return lambda s, d: f(assets(s, d), *args, **kw)


def _day(df):
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _events(s, d):
    e = s.createDataFrame([("E1", "1996-02-03"), ("E2", "1996-04-10")], "event_id string, event_date string").withColumn("event_date", F.to_date("event_date"))
    return _round(_day(finance.event_windows(assets(s, d), e)), "value")


EVENT_SQL = f"""{A}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY observation_date) AS pos FROM assets), ev AS (SELECT * FROM (VALUES ('E1', DATE '1996-02-03'), ('E2', DATE '1996-04-10')) AS v(event_id, event_date)),
p AS (SELECT event_id, asset_id, min(pos) AS p0 FROM r JOIN ev ON observation_date >= event_date GROUP BY ALL)
SELECT event_id, asset_id, pos - p0 AS "offset", {DAY}, round(value, 6) AS value FROM r JOIN p USING (asset_id) WHERE pos >= p0 - 3 AND pos < p0 + 3"""


def _lag_week(s, d):
    r = finance.weekly_returns(assets(s, d), START)
    o = r.groupBy("week").agg(F.sum("n_return_obs").alias("outcome"))
    return finance.week_lag_join(o, r).select("week", "lag", "asset_id", "outcome", "weekly_log_change")


def _spearman(s, d):
    r = finance.weekly_returns(assets(s, d), START)
    return finance.spearman(r.select("asset_id", F.col("week").alias("x"), F.round("weekly_log_change", 3).alias("y")), "asset_id")


RET = f"{CH}, ret AS (SELECT {WEEK} AS week, asset_id, CAST(min(observation_date) AS VARCHAR) AS first_date, CAST(max(observation_date) AS VARCHAR) AS last_date, count(*) AS n_return_obs, round(sum(change), 8) AS weekly_log_change, round(exp(sum(change)) - 1, 8) AS weekly_simple_change FROM ch WHERE change IS NOT NULL AND transform = 'log_return' GROUP BY ALL)"


def _bh(s, d):
    t = records(s, d).groupBy("platform", "query_id").agg(F.count("*").alias("n")).filter("query_id IS NOT NULL")
    t = t.select(F.col("platform").alias("family"), F.col("query_id").alias("test_id"), F.round((F.col("n") % 97) / 97.0, 6).alias("p_value"))
    return finance.benjamini_hochberg(t)


BH_SQL = f"""WITH {RECORDS_SQL}, t AS (SELECT platform AS family, query_id AS test_id, round((count(*) % 97) / 97.0e0, 6) AS p_value FROM records WHERE query_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, p_value * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p_value, test_id) AS r FROM t)
SELECT family, test_id, p_value, round(least(1.0e0, min(r) OVER (PARTITION BY family ORDER BY p_value DESC, test_id DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r"""


def _pairs(s, d):
    """Predictions of three routes: the true label, shifted now and then."""
    r = records(s, d).select(F.explode(F.array(*[F.lit(x) for x in ("r1", "r2", "r3")])).alias("route"), "content_id", F.col("sentiment_label").alias("y_true"), "stance_label", "language_detected", F.col("content_id").cast("long").alias("i"))
    return r.withColumn("y_pred", F.when(F.col("i") % (F.substring("route", 2, 1).cast("int") + 2) == 0, "mixed").otherwise(F.col("y_true")))


PAIRS = f"WITH {RECORDS_SQL}, pr AS (SELECT route, content_id, sentiment_label AS y_true, language_detected, CASE WHEN content_id::BIGINT % (substr(route, 2, 1)::INT + 2) = 0 THEN 'mixed' ELSE sentiment_label END AS y_pred FROM records CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) AS v(route))"
METRICS_SQL = f"""{PAIRS}, cl AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in SENTIMENTS)}) AS v(label)),
m AS (SELECT route, label, count(*) AS n, round(avg((y_true = y_pred)::INT), 6) AS accuracy, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_pred = label AND y_true <> label) AS fp, count(*) FILTER (WHERE y_true = label AND y_pred <> label) AS fn FROM pr CROSS JOIN cl GROUP BY ALL),
f AS (SELECT *, coalesce(tp * 1.0e0 / nullif(tp + fp, 0), 0) AS p, coalesce(tp * 1.0e0 / nullif(tp + fn, 0), 0) AS r FROM m), g AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM f)
SELECT route, label, n, accuracy, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, tp + fn AS support, round(coalesce(avg(f) FILTER (WHERE tp + fn > 0) OVER (PARTITION BY route), 0), 6) AS macro_f1 FROM g"""


def _kappa(s, d):
    lab = table(s, d, "labels")
    return annotation.kappa(lab.select(F.lit("quality_vs_toxic").alias("axis"), F.col("quality").cast("string").alias("label_a"), F.col("toxic").cast("string").alias("label_b")))


KAPPA_SQL = """WITH c AS (SELECT count(*) AS n, sum((quality = toxic)::INT) AS a, sum(quality) AS q, sum(toxic) AS t FROM labels), p AS (SELECT n, a * 1.0e0 / n AS po, (q * t + (n - q) * (n - t)) * 1.0e0 / (n * n) AS pe FROM c)
SELECT 'quality_vs_toxic' AS axis, n AS n_compared, round(po, 6) AS percent_agreement, round(CASE WHEN pe = 1 THEN 1.0e0 ELSE (po - pe) / (1 - pe) END, 6) AS cohens_kappa FROM p"""


def _audited(s, d):
    return table(s, d, "labels").join(texts(s, d), F.col("doc_id") == F.col("record_id")).select("platform", (F.col("quality") == 1).alias("eligible"), F.when(F.col("doc_id") % 9 == 0, "uncertain").when(F.col("toxic") == 0, "relevant").otherwise("not_relevant").alias("human_relevance"))


AUDIT_SQL = f"""WITH {TEXTS_SQL}, a AS (SELECT platform, quality = 1 AS e, CASE WHEN doc_id % 9 = 0 THEN 'uncertain' WHEN toxic = 0 THEN 'relevant' ELSE 'not_relevant' END AS h FROM labels JOIN texts ON doc_id = record_id)
SELECT platform, count(*) AS n, count(*) FILTER (WHERE e AND h <> 'uncertain') AS n_included_reviewed, count(*) FILTER (WHERE NOT e AND h <> 'uncertain') AS n_excluded_reviewed, count(*) FILTER (WHERE h = 'uncertain') AS n_uncertain, round(avg((h = 'relevant')::INT) FILTER (WHERE e AND h <> 'uncertain'), 6) AS inclusion_precision, round(avg((h = 'relevant')::INT) FILTER (WHERE NOT e AND h <> 'uncertain'), 6) AS false_exclusion_rate FROM a GROUP BY platform"""


def _calls(s, d):
    i = F.col("i")
    return _pairs(s, d).select("route", "content_id", F.when(i % 17 == 0, "api_failure").when(i % 13 == 0, "json_parse_failure").otherwise("ok").alias("annotation_status"), (i % 50 / 1000.0).alias("cost_usd"), (i % 700 + 100.0).alias("latency_ms"), F.when(F.col("route") == "r3", None).otherwise(i % 300 + 20).alias("tokens"))


CALLS = f"{PAIRS}, cs AS (SELECT route, content_id::BIGINT AS i, CASE WHEN content_id::BIGINT % 17 = 0 THEN 'api_failure' WHEN content_id::BIGINT % 13 = 0 THEN 'json_parse_failure' ELSE 'ok' END AS st, (content_id::BIGINT % 50) / 1000.0e0 AS cost, content_id::BIGINT % 700 + 100.0e0 AS lat, CASE WHEN route = 'r3' THEN NULL ELSE content_id::BIGINT % 300 + 20 END AS tokens FROM pr)"
SCORE_SQL = f"{CALLS} SELECT route, count(*) AS n_calls, round(avg((st = 'api_failure')::INT), 6) AS failure_rate, round(avg((st = 'json_parse_failure')::INT), 6) AS parse_failure_rate, round(avg((st = 'ok')::INT), 6) AS coverage, round(1000 * avg(cost), 6) AS cost_per_1000, round(avg(lat), 4) AS mean_latency_ms FROM cs GROUP BY route"
COST_SQL = f"{CALLS}, t AS (SELECT avg(tokens) AS sh, avg(lat) AS sl FROM cs), p AS (SELECT route, count(tokens) AS k, avg(tokens) AS own, avg(lat) AS lat FROM cs GROUP BY route) SELECT route, k AS n_calls, CASE WHEN k >= 3 THEN 'own' WHEN sh IS NOT NULL THEN 'cross_route' ELSE 'structural' END AS basis, round(CASE WHEN k >= 3 THEN own ELSE sh END * 0.5 / 1000000 * 233006, 4) AS cost_usd, round(CASE WHEN k >= 3 THEN lat ELSE sl END * 233006 / 3600000.0e0, 4) AS sequential_hours FROM p, t"


def _attempts(s, d):
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("c"), (F.col("event_id") % 500).cast("string")).alias("content_id"), F.concat(F.lit("T"), (F.col("event_id") % 2).cast("string")).alias("target_id"), F.when(F.col("event_id") % 5 == 0, "api_failure").otherwise("ok").alias("annotation_status"), F.col("ts").cast("timestamp").alias("annotated_at"), F.col("event_id").alias("attempt"))


ATT = "WITH att AS (SELECT 'c' || (event_id % 500) AS content_id, 'T' || (event_id % 2) AS target_id, CASE WHEN event_id % 5 = 0 THEN 'api_failure' ELSE 'ok' END AS annotation_status, ts AS annotated_at, event_id AS attempt FROM events)"


def _payload(s, d):
    r = records(s, d)
    i = F.col("content_id").cast("long")
    body = F.to_json(F.struct(F.col("sentiment_label").alias("sentiment"), F.when(i % 7 == 0, "maybe").otherwise(F.col("stance_label")).alias("stance"), F.col("emotion_label").alias("emotion"), F.col("content_type_label").alias("content_type"), F.when(i % 11 == 0, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"), F.when(i % 13 == 0, " ").otherwise("clear").alias("reason_code")))
    answer = F.when(i % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 17 == 0, "no json {").when(i % 19 == 0, F.regexp_replace(body, r'"confidence":([0-9.]+)', r'"confidence":"$1"')).otherwise(body)
    _, error = annotation.parse_payload(answer, {"sentiment": SENTIMENTS, "stance": LABEL_AXES["stance"][1], "emotion": LABEL_AXES["emotion"][1], "content_type": LABEL_AXES["content_type"][1]})
    return r.select(F.coalesce(error, F.lit("valid")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


PAYLOAD_SQL = f"WITH {RECORDS_SQL}, i AS (SELECT content_id::BIGINT AS i FROM records) SELECT CASE WHEN i % 5 <> 0 AND i % 17 = 0 THEN 'json_parse_failure' WHEN i % 7 = 0 THEN 'invalid_stance' WHEN i % 11 = 0 OR (i % 5 <> 0 AND i % 19 = 0) THEN 'invalid_confidence' WHEN i % 13 = 0 THEN 'blank_reason_code' ELSE 'valid' END AS outcome, count(*) AS n FROM i GROUP BY 1"
HASH = "md5('1405:' || {c})"


def _bridge(s, d):
    r = records(s, d).select("content_id", "platform", F.when(F.col("is_near_duplicate"), F.concat(F.lit("n"), "content_id")).alias("near_duplicate_cluster_id"), F.col("is_exact_duplicate").alias("duplicate_text_diff_id"), F.when(F.col("is_exact_duplicate"), F.lit("txt_1")).alias("duplicate_text_group_id"))
    a = table(s, d, "events").filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("content_id"), F.explode(F.array(F.lit("T1"), F.lit("T2"))).alias("target"), F.lit("ok").alias("annotation_status"))
    return annotation.bridge(r, a).select("content_id", "platform", "target", "annotation_status", "is_near_duplicate", "near_duplicate_cluster_id")


BRIDGE_SQL = f"WITH {RECORDS_SQL}, a AS (SELECT event_id::VARCHAR AS content_id, t AS tgt FROM events CROSS JOIN (VALUES ('T1'), ('T2')) AS v(t) WHERE event_id % 3 = 0) SELECT r.content_id, r.platform, a.tgt AS target, CASE WHEN a.tgt IS NULL THEN 'pending_annotation' ELSE 'ok' END AS annotation_status, r.is_near_duplicate OR r.is_exact_duplicate AS is_near_duplicate, CASE WHEN r.is_near_duplicate THEN 'n' || r.content_id WHEN r.is_exact_duplicate THEN 'txt_1' END AS near_duplicate_cluster_id FROM records r LEFT JOIN a USING (content_id)"


def _weeks(s):
    return PROJECT.weeks(s)


def _grades(s, d):
    return quality.grade(quality.profile(texts(s, d).withColumn("ts", F.when(F.col("record_id") % 90 != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("record_id") * 3600))), "record_id", "ts", "text", "platform"))


GRADE_SQL = f"""WITH {TEXTS_SQL}, t AS (SELECT *, CASE WHEN record_id % 90 <> 0 THEN make_timestamp((1704067200 + record_id * 3600) * 1000000) END AS ts FROM texts),
p AS (SELECT platform, count(*) AS raw_n, count(DISTINCT record_id) AS distinct_ids, count(record_id) - count(DISTINCT record_id) AS duplicate_ids, count(*) FILTER (WHERE record_id IS NULL) AS missing_id_n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing_text_n, count(*) FILTER (WHERE ts IS NULL) AS missing_timestamp_n, count(DISTINCT ts::DATE) AS n_days, count(DISTINCT strftime(ts, '%G-W%V')) AS n_iso_weeks FROM t GROUP BY platform)
SELECT *, CASE WHEN missing_text_n > 0.2 * raw_n OR missing_timestamp_n > 0.2 * raw_n THEN 'C' WHEN missing_text_n > 0 OR missing_timestamp_n > 0 OR duplicate_ids > 0 THEN 'B' ELSE 'A' END AS grade, concat_ws(';', CASE WHEN missing_text_n > 0 THEN 'missing_text' END, CASE WHEN missing_timestamp_n > 0 THEN 'missing_timestamp' END, CASE WHEN duplicate_ids > 0 THEN 'duplicate_id' END) AS reasons FROM p"""
QUERY_IDS = [f"Q{k}" for k in range(9)]
QGRID = ", ".join(f"('{q}')" for q in QUERY_IDS)


def _checks(s, d):
    r = records(s, d)
    return quality.check_table(r, {"id_present": F.col("content_id").isNotNull(), "confidence_in_range": F.col("confidence").between(0, 1), "author_known": F.col("author_hash").isNotNull(), "engagement_not_negative": F.coalesce("engagement_score", F.lit(0.0)) >= 0})


def _tails(bound, density):
    """Both tails beyond ``bound`` of a symmetric density of x, by Simpson's rule in 4,000 steps; what lies beyond 40 is nothing."""
    h = f"(least({bound}, 40.0e0) / 4000)"
    points = f"list_sum([(CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({re.sub(r'\bx\b', f'(i * {h})', density)}) FOR i IN range(4001)])"
    return f"CASE WHEN {bound} > 40 THEN 0.0e0 ELSE round(abs(1 - 2 * {h} / 3 * {points}), 6) END"


def _mw(s, d):
    return inference.mann_whitney(records(s, d).withColumn("v", F.round("engagement_score", 0)), "platform", "v", "x", "reddit")


MW_SQL = f"""WITH {RECORDS_SQL}, t AS (SELECT platform, round(engagement_score, 0) AS v FROM records WHERE platform IN ('x', 'reddit') AND engagement_score IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0 AS r FROM t),
g AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY v)), s AS (SELECT count(*) FILTER (WHERE platform = 'x') AS n1, count(*) FILTER (WHERE platform = 'reddit') AS n2, sum(r) FILTER (WHERE platform = 'x') AS ra FROM k),
u AS (SELECT *, ra - n1 * (n1 + 1) / 2.0e0 AS u FROM s, g), w AS (SELECT *, (abs(u - n1 * n2 / 2.0e0) - 0.5) / sqrt(n1 * n2 / 12.0e0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0e0)))) AS z FROM u)
SELECT n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, {_tails('greatest(z, 0)', 'exp(-x * x / 2) / sqrt(2 * pi())')} AS p_value FROM w"""
# The tail is the closed form of even degrees of freedom, as with three platforms.
CHI_SQL = f"""{BASE}, c AS (SELECT platform AS a, stance_label AS b, count(*) AS o FROM ok GROUP BY ALL), t AS (SELECT sum(o) AS n FROM c), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), q AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
x AS (SELECT sum((coalesce(o, 0) - ra * cb * 1.0e0 / n) ** 2 / (ra * cb * 1.0e0 / n)) AS x, max(n) AS n FROM r CROSS JOIN q CROSS JOIN t LEFT JOIN c USING (a, b)) SELECT n::BIGINT AS n, round(x, 6) AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM q) - 1) AS dof, round(sqrt(x / n / least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM q) - 1)), 6) AS cramers_v,
round(exp(-x / 2) * list_sum([(x / 2) ** i / gamma(i + 1.0e0) FOR i IN range(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM q) - 1) // 2)]), 6) AS p_value FROM x"""
WELCH_SQL = f"""{BASE}, s AS (SELECT count(engagement_score) FILTER (WHERE platform = 'x') AS n1, avg(engagement_score) FILTER (WHERE platform = 'x') AS m1, var_samp(engagement_score) FILTER (WHERE platform = 'x') AS v1, count(engagement_score) FILTER (WHERE platform = 'youtube') AS n2, avg(engagement_score) FILTER (WHERE platform = 'youtube') AS m2, var_samp(engagement_score) FILTER (WHERE platform = 'youtube') AS v2 FROM ok),
w AS (SELECT *, abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS k FROM s)
SELECT n1, n2, round(m1 - m2, 6) AS difference, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS dof, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0e0 / (4 * (n1 + n2) - 9)), 6) AS hedges_g, round(m1 - m2 - 1.959963984540054 * sqrt(v1 / n1 + v2 / n2), 6) AS ci_low, round(m1 - m2 + 1.959963984540054 * sqrt(v1 / n1 + v2 / n2), 6) AS ci_high, {_tails('t', 'exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / sqrt(k * pi()) * (1 + x * x / k) ** (-(k + 1) / 2)')} AS p_value FROM w"""
FISHER_SQL = f"""{BASE}, x AS (SELECT count(*) FILTER (WHERE platform = 'x' AND sentiment_label = 'positive') AS a, count(*) FILTER (WHERE platform = 'x' AND sentiment_label <> 'positive') AS b, count(*) FILTER (WHERE platform = 'reddit' AND sentiment_label = 'positive') AS c, count(*) FILTER (WHERE platform = 'reddit' AND sentiment_label <> 'positive') AS d FROM ok),
l AS (SELECT *, ln(a * d * 1.0e0 / (b * c)) AS l, 1.959963984540054 * sqrt(1.0e0 / a + 1.0e0 / b + 1.0e0 / c + 1.0e0 / d) AS se FROM x),
h AS (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i, a, b, c, d FROM x), lp AS (SELECT *, -(lgamma(i + 1.0e0) + lgamma(a + b - i + 1.0e0) + lgamma(a + c - i + 1.0e0) + lgamma(d - a + i + 1.0e0)) AS lp FROM h),
tot AS (SELECT max(lp) AS m, max(lp) FILTER (WHERE i = a) AS seen FROM lp), pv AS (SELECT least(1.0e0, sum(exp(lp - m)) FILTER (WHERE lp <= seen + 1e-7) / sum(exp(lp - m))) AS p FROM lp, tot)
SELECT a, b, c, d, round(exp(l), 6) AS odds_ratio, round(exp(l - se), 6) AS or_low, round(exp(l + se), 6) AS or_high, round(p, 6) AS p_value FROM l, pv"""
OKR = lambda s, d: records(s, d).filter("annotation_status = 'ok'")

#: CRC-32 byte by byte and bit by bit; ids are ASCII.
CRC_SQL = f"""WITH {RECORDS_SQL}, b AS (SELECT list_prepend(4294967295::BIGINT, list_transform(string_split(content_id, ''), lambda c: ascii(c)::BIGINT)) AS bytes FROM records),
c AS (SELECT xor(list_reduce(bytes, lambda crc, x: list_reduce([xor(crc, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) AS crc FROM b)
SELECT crc % 4 AS shard, count(*) AS n FROM c GROUP BY 1"""


QUERIES = {
    "asset_changes": (lambda s, d: _round(_day(finance.changes(assets(s, d))), "value", "change"), f"{CH} SELECT {DAY}, asset_id, round(value, 6) AS value, transform, round(change, 6) AS change FROM ch"),
    "asset_volatility": (lambda s, d: _round(_day(finance.rolling_volatility(assets(s, d))), "volatility"), f"{CH}, c AS (SELECT * FROM ch WHERE change IS NOT NULL) SELECT {DAY}, asset_id, round(CASE WHEN count(change) OVER w = 10 THEN stddev_samp(change) OVER w * sqrt(252) END, 6) AS volatility FROM c WINDOW w AS (PARTITION BY asset_id ORDER BY c.observation_date ROWS 9 PRECEDING)"),
    "asset_basket": (lambda s, d: _round(_day(finance.basket(assets(s, d))), "basket"), f"{A}, b AS (SELECT min(observation_date) AS bd FROM (SELECT observation_date FROM assets GROUP BY 1 HAVING count(DISTINCT asset_id) = (SELECT count(DISTINCT asset_id) FROM assets))), v AS (SELECT asset_id, value AS base FROM assets, b WHERE observation_date = bd) SELECT CAST(observation_date AS VARCHAR) AS observation_date, round(avg(100 * value / base), 6) AS basket, count(value) AS n_members FROM assets JOIN v USING (asset_id) GROUP BY assets.observation_date"),
    "asset_spread": (lambda s, d: _round(_day(finance.spread(assets(s, d), NAMES[0], NAMES[1])), "spread"), f"{A} SELECT CAST(x.observation_date AS VARCHAR) AS observation_date, round(x.value - y.value, 6) AS spread FROM assets x JOIN assets y ON x.observation_date = y.observation_date AND x.asset_id = '{NAMES[0]}' AND y.asset_id = '{NAMES[1]}'"),
    "asset_panel": (lambda s, d: _round(_day(finance.calendar_panel(assets(s, d))), "value"), f"{PANEL} SELECT {DAY}, asset_id, round(value, 6) AS value, reason, market_open FROM panel"),
    "asset_weekly_returns": (lambda s, d: _day(finance.weekly_returns(assets(s, d), START)), f"{RET} SELECT * FROM ret"),
    "asset_weekly_coverage": (_a(finance.weekly_coverage, START), f"{PANEL} SELECT * FROM covr"),
    "asset_coverage_summary": (lambda s, d: _day(finance.coverage_summary(assets(s, d), START)), f"{PANEL}, w AS (SELECT asset_id, count(*) AS n_weeks, round(min(coverage_ratio), 6) AS min_ratio, round(quantile_cont(coverage_ratio, 0.5), 6) AS median_ratio FROM covr WHERE open_days > 0 GROUP BY 1) SELECT w.*, CAST(f AS VARCHAR) AS first_date, CAST(l AS VARCHAR) AS last_date, median_ratio >= 0.6 AS is_eligible FROM w JOIN nm USING (asset_id)"),
    "asset_weekly_last": (lambda s, d: _round(finance.weekly_last(assets(s, d), START), "last_value"), f"{A} SELECT {WEEK} AS week, asset_id, round(max_by(value, observation_date), 6) AS last_value FROM assets GROUP BY ALL"),
    "asset_observation_counts": (_a(finance.observation_counts, START, NAMES), f"{A} SELECT {WEEK} AS week, " + ", ".join(f"count(*) FILTER (WHERE asset_id = '{n}') AS \"{n}\"" for n in NAMES) + " FROM assets GROUP BY 1"),
    "asset_event_windows": (_events, EVENT_SQL),
    "asset_cross_check": (_a(finance.cross_check, NAMES[0], NAMES[1]), f"{CH}, j AS (SELECT x.value AS x, y.value AS y, x.change AS dx, y.change AS dy FROM ch x JOIN ch y ON x.observation_date = y.observation_date AND x.asset_id = '{NAMES[0]}' AND y.asset_id = '{NAMES[1]}'), s AS (SELECT count(*) AS n, quantile_cont(abs(x - y) / y, 0.5) AS d, corr(dx, dy) AS r, avg((sign(dx) = sign(dy))::INT) AS s FROM j) SELECT n AS n_common, round(d, 6) AS median_relative_difference, round(r, 6) AS return_correlation, round(s, 6) AS same_sign_share, CASE WHEN d < 0.02 THEN 'level_match' WHEN r >= 0.9 AND s >= 0.9 THEN 'return_match' ELSE 'mismatch' END AS status FROM s"),
    "asset_lag_correlations": (_a(finance.lag_correlations), f"{CH}, c AS (SELECT * FROM ch WHERE change IS NOT NULL), l AS (SELECT * FROM (VALUES (0), (1), (3), (7)) AS v(lag)) SELECT x.asset_id AS x_asset, y.asset_id AS y_asset, lag, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(corr(x.change, y.change), 6) END AS r FROM c x CROSS JOIN l JOIN c y ON y.observation_date = x.observation_date + lag WHERE x.asset_id <> y.asset_id GROUP BY ALL"),
    "asset_spearman": (_spearman, f"{RET}, y AS (SELECT asset_id, week AS x, round(weekly_log_change, 3) AS y FROM ret), r AS (SELECT asset_id, rank() OVER (PARTITION BY asset_id ORDER BY x) + (count(*) OVER (PARTITION BY asset_id, x) - 1) / 2.0e0 AS rx, rank() OVER (PARTITION BY asset_id ORDER BY y) + (count(*) OVER (PARTITION BY asset_id, y) - 1) / 2.0e0 AS ry FROM y) SELECT asset_id, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1"),
    "week_lag_join": (_lag_week, f"{RET}, o AS (SELECT week, sum(n_return_obs)::BIGINT AS outcome FROM ret GROUP BY 1) SELECT o.week, lag, asset_id, outcome, weekly_log_change FROM o CROSS JOIN (VALUES (0), (1), (2)) AS v(lag) JOIN ret ON ret.week = o.week + lag"),
    "false_discovery_rate": (_bh, BH_SQL),
    "asset_permutation": (lambda s, d: finance.permutation_p(finance.weekly_returns(assets(s, d), START).select("asset_id", F.col("week").cast("double").alias("x"), F.col("weekly_log_change").alias("y")), "asset_id"), None),
    "asset_stationarity": (_a(finance.stationarity), None),
    "label_metrics": (lambda s, d: annotation.class_metrics(_pairs(s, d), SENTIMENTS), METRICS_SQL),
    "label_breakdown": (lambda s, d: annotation.breakdown_accuracy(_pairs(s, d), "route", "language_detected"), f"{PAIRS} SELECT route, language_detected, count(*) FILTER (WHERE y_true = y_pred) AS correct, count(*) AS total, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM pr GROUP BY ALL"),
    "label_kappa": (_kappa, KAPPA_SQL),
    "relevance_audit": (lambda s, d: annotation.audit_metrics(_audited(s, d), "platform"), AUDIT_SQL),
    "route_scorecard": (lambda s, d: annotation.route_scorecard(_calls(s, d)), SCORE_SQL),
    "cost_projection": (lambda s, d: annotation.cost_projection(_calls(s, d), 233006, 400, 0.5), COST_SQL),
    "unanimous_labels": (lambda s, d: annotation.unanimous_share(_pairs(s, d).select(F.lit("sentiment").alias("axis"), "content_id", F.col("y_pred").alias("label"))), f"{PAIRS}, k AS (SELECT content_id, count(DISTINCT y_pred) AS k FROM pr GROUP BY 1) SELECT 'sentiment' AS axis, count(*) AS n, round(avg((k = 1)::INT), 6) AS unanimous_share FROM k"),
    "best_attempt": (lambda s, d: dedup.best_attempt(_attempts(s, d)).select("content_id", "target_id", "annotation_status", "attempt"), f"{ATT} SELECT content_id, target_id, annotation_status, attempt FROM att QUALIFY row_number() OVER (PARTITION BY content_id, target_id ORDER BY annotation_status = 'ok' DESC, annotated_at DESC, attempt DESC) = 1"),
    "payload_validation": (_payload, PAYLOAD_SQL),
    "annotation_bridge": (_bridge, BRIDGE_SQL),
    "annotation_pending": (lambda s, d: annotation.pending(records(s, d), records(s, d).select("content_id", "annotation_status")).select("content_id"), f"WITH {RECORDS_SQL} SELECT content_id FROM records WHERE annotation_status <> 'ok'"),
    "sample_capped": (lambda s, d: sampling.stratified_cap(records(s, d), "content_id", ("platform", "project_week"), 20).select("content_id", "platform", "project_week"), f"WITH {RECORDS_SQL} SELECT content_id, platform, project_week FROM records QUALIFY row_number() OVER (PARTITION BY platform, project_week ORDER BY {HASH.format(c='content_id')}, content_id) <= 20"),
    "sample_quota": (lambda s, d: sampling.quota_sample(texts(s, d), "record_id", ("platform", "lang"), 12, 160).select("record_id", "platform", "lang", F.col("sample_pass").cast("long").alias("sample_pass")), f"WITH {TEXTS_SQL}, r AS (SELECT *, {HASH.format(c='record_id')} AS h, row_number() OVER (PARTITION BY platform, lang ORDER BY {HASH.format(c='record_id')}, record_id) AS r FROM texts), o AS (SELECT *, row_number() OVER (ORDER BY h, record_id) AS k FROM r WHERE r > 12) SELECT record_id, platform, lang, 1::BIGINT AS sample_pass FROM r WHERE r <= 12 UNION ALL SELECT record_id, platform, lang, 2 FROM o WHERE k <= greatest(0, 160 - (SELECT count(*) FROM r WHERE r <= 12))"),
    "sample_blinded": (lambda s, d: sampling.blinded_audit(records(s, d), "content_id", ("platform", "is_near_duplicate"), 10).select("audit_id", "content_id", "platform", "is_near_duplicate"), f"WITH {RECORDS_SQL}, p AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY platform, is_near_duplicate ORDER BY {HASH.format(c='content_id')}, content_id) <= 10) SELECT 'RA1405-' || lpad((row_number() OVER (ORDER BY md5('1412:' || content_id), content_id))::VARCHAR, 4, '0') AS audit_id, content_id, platform, is_near_duplicate FROM p"),
    "shard_crc32": (lambda s, d: sampling.sharded(records(s, d), "content_id", 4).groupBy("shard").agg(F.count("*").alias("n")), CRC_SQL),
    "platform_grades": (_grades, GRADE_SQL),
    "query_week_audit": (lambda s, d: quality.query_week_audit(records(s, d), _weeks(s), QUERY_IDS), f"{BASE}, q AS (SELECT * FROM (VALUES {QGRID}) AS v(query_id)), c AS (SELECT query_id, project_week, count(DISTINCT content_id) AS a, count(DISTINCT author_hash) AS b FROM records GROUP BY ALL) SELECT query_id, project_week, coalesce(a, 0) AS n_contents, coalesce(b, 0) AS n_authors, CASE WHEN a IS NULL THEN 'EMPTY' ELSE 'OK' END AS status FROM q CROSS JOIN (SELECT project_week FROM weeks) LEFT JOIN c USING (query_id, project_week)"),
    "weekly_volume": (lambda s, d: quality.weekly_volume(records(s, d), _weeks(s)), f"{BASE}, c AS (SELECT project_week, count(content_id) AS n_rows, count(DISTINCT post_id) AS n_posts, count(DISTINCT author_hash) AS n_users FROM weeks LEFT JOIN records USING (project_week) GROUP BY 1) SELECT *, CASE WHEN n_rows = 0 THEN 'EMPTY' WHEN n_rows < 0.25 * (SELECT quantile_cont(n_rows, 0.5) FROM c WHERE n_rows > 0) THEN 'LOW' ELSE 'OK' END AS status FROM c"),
    "run_manifest": (lambda s, d: quality.run_manifest(records(s, d), "query_id", "project_week"), f"WITH {RECORDS_SQL} SELECT query_id, project_week, count(*) AS n_rows, count(DISTINCT author_hash) AS n_authors, min(epoch(created_at)::BIGINT) AS first_s, max(epoch(created_at)::BIGINT) AS last_s FROM (SELECT * REPLACE (date_trunc('second', created_at) AS created_at) FROM records) GROUP BY ALL"),
    "quality_checks": (_checks, f"WITH {RECORDS_SQL} SELECT n AS check_name, f AS n_failed, f = 0 AS passed FROM (SELECT 'id_present' AS n, count(*) FILTER (WHERE content_id IS NULL) AS f FROM records UNION ALL SELECT 'confidence_in_range', count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 1) FROM records UNION ALL SELECT 'author_known', count(*) FILTER (WHERE author_hash IS NULL) FROM records UNION ALL SELECT 'engagement_not_negative', count(*) FILTER (WHERE engagement_score < 0) FROM records)"),
    "job_status_counts": (lambda s, d: quality.count_by_status(records(s, d), "annotation_status"), f"WITH {RECORDS_SQL} SELECT annotation_status, count(*) AS n_jobs FROM records GROUP BY 1"),
    "test_chi_square": (lambda s, d: inference.chi_square(OKR(s, d), "platform", "stance_label"), CHI_SQL),
    "test_mann_whitney": (_mw, MW_SQL),
    "test_welch": (lambda s, d: inference.welch(OKR(s, d), "platform", "engagement_score", "x", "youtube"), WELCH_SQL),
    "test_fisher": (lambda s, d: inference.fisher(OKR(s, d).withColumn("hit", F.col("sentiment_label") == "positive"), "platform", "hit", "x", "reddit"), FISHER_SQL),
    "group_comparisons": (lambda s, d: battery.battery(records(s, d), PLATFORMS), None),
    "bootstrap_share": (lambda s, d: inference.bootstrap_share(OKR(s, d).withColumn("hit", F.col("sentiment_label") == "positive"), "hit", "platform"), None),
}
