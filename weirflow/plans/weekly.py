"""Queries over the weekly records and their SQL twins."""

from __future__ import annotations

from weirflow.calendar import OUT, PROJECT
from weirflow.functions.stats import Z, wilson_sql
from weirflow.operators import composition, descriptive, events, sensitivity, trend
from weirflow.operators.trend import OUTCOMES
from weirflow.sources.bindings import LABEL_AXES, LANGUAGES, PLATFORMS, RECORDS_SQL, records


def _values(name: str, column: str, values) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in values) + f") AS t({column}))"


WEEKS = f"weeks AS ({PROJECT.weeks_sql()}), {_values('plats', 'platform', PLATFORMS)}, grid AS (SELECT * FROM plats CROSS JOIN weeks)"
BASE = f"WITH {RECORDS_SQL}, {WEEKS}, ok AS (SELECT * FROM records WHERE annotation_status = 'ok')"
FLAGS = "{n} = 0 AS is_data_gap, {n} > 0 AND {n} < 30 AS is_low_sample"


def _share(k: str, n: str) -> str:
    return f"round(({k}) * 1.0e0 / nullif({n}, 0), 4)"


def _trend_sql(column: str, classes) -> str:
    return f"""{BASE}, {_values('classes', 'class_label', classes)},
c AS (SELECT platform, project_week, {column} AS class_label, count(*) AS k FROM ok GROUP BY ALL),
t AS (SELECT platform, project_week, count(*) AS n FROM ok GROUP BY ALL),
j AS (SELECT g.*, class_label, coalesce(n, 0) AS n, coalesce(k, 0) AS class_count FROM grid g CROSS JOIN classes LEFT JOIN t USING (platform, project_week) LEFT JOIN c USING (platform, project_week, class_label))
SELECT platform, project_week, class_label, n, class_count, {_share('class_count', 'n')} AS class_proportion,
  {wilson_sql('class_count', 'n', '-')} AS wilson_ci_low, {wilson_sql('class_count', 'n', '+')} AS wilson_ci_high, is_partial_week, {FLAGS.format(n='n')} FROM j"""


def _outcomes_sql() -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE {c} = {repr(v) if isinstance(v, str) else str(v).lower()}) AS {o}" for o, (c, v) in OUTCOMES.items())
    parts = " UNION ALL ".join(f"SELECT platform, project_week, '{o}' AS outcome_id, coalesce(n, 0) AS n_records, coalesce({o}, 0) AS k FROM w" for o in OUTCOMES)
    return f"""{BASE}, a AS (SELECT platform, project_week, count(*) AS n, {hits} FROM ok GROUP BY ALL),
w AS (SELECT * FROM grid LEFT JOIN a USING (platform, project_week)), l AS ({parts})
SELECT platform, project_week, outcome_id, {_share('k', 'n_records')} AS outcome_value, n_records, {wilson_sql('k', 'n_records', '-')} AS ci_low, {wilson_sql('k', 'n_records', '+')} AS ci_high FROM l"""


LEVEL = f"week_records AS (SELECT *, CASE WHEN project_week IS NULL OR project_week = '{OUT}' THEN 'untimed' ELSE project_week END AS week FROM records)"
LEVELS_GRID = """levels AS (SELECT 'overall' AS group_level, NULL::VARCHAR AS platform, NULL::VARCHAR AS week UNION ALL SELECT 'platform', platform, NULL FROM plats
UNION ALL SELECT 'week_pooled', NULL, week FROM wk UNION ALL SELECT 'platform_week', platform, week FROM plats CROSS JOIN wk), """
WK = "wk AS (SELECT project_week AS week FROM weeks UNION ALL SELECT 'untimed'), "
SETS = "GROUPING SETS ((), (platform), (week), (platform, week))"
LEVEL_NAME = "CASE grouping(platform) * 2 + grouping(week) WHEN 3 THEN 'overall' WHEN 1 THEN 'platform' WHEN 2 THEN 'week_pooled' ELSE 'platform_week' END AS group_level"
SAME = "l.group_level = f.group_level AND l.platform IS NOT DISTINCT FROM f.platform AND l.week IS NOT DISTINCT FROM f.week"


def _summary_sql() -> str:
    distinct = {"content_id": "content_id", "text_raw": "text_raw", "parent_id": "parent_id", "post_id": "post_id", "author_hash": "author_hash", "query_id": "query_id"}
    counts = ["n_total", "n_annotation_ok", "n_opinion_untimed", *[f"n_unique_{c}" for c in distinct]]
    quarters = [(n, p, q) for n in ("text_length", "engagement_score") for p, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return f"""{BASE}, {WK}{LEVELS_GRID}{LEVEL},
r AS (SELECT *, length(text_raw) AS text_length FROM week_records),
f AS (SELECT {LEVEL_NAME}, platform, week, count(*) AS n_total, count(*) FILTER (WHERE annotation_status = 'ok') AS n_annotation_ok, count(*) FILTER (WHERE dataset_target = 'opinion_untimed') AS n_opinion_untimed,
 {', '.join(f'count(DISTINCT {c}) AS n_unique_{c}' for c in distinct)}, round(avg(is_exact_duplicate::INT), 4) AS duplicate_rate_exact, round(avg(is_near_duplicate::INT), 4) AS duplicate_rate_near,
 {', '.join(f'quantile_cont({n}, {q}) AS {n}_{p}' for n, p, q in quarters)} FROM r GROUP BY {SETS})
SELECT l.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in counts)}, coalesce(n_total, 0) - coalesce(n_annotation_ok, 0) AS n_annotation_non_ok,
 round(100.0e0 * (n_total - n_annotation_ok) / nullif(n_total, 0), 2) AS pct_annotation_non_ok, duplicate_rate_exact, duplicate_rate_near,
 {', '.join(f'round({n}_{p}, 4) AS {n}_{p}' for n, p, _ in quarters)}, {', '.join(f'round({n}_q3 - {n}_q1, 4) AS {n}_iqr' for n in ('text_length', 'engagement_score'))}
FROM levels l LEFT JOIN f ON {SAME}"""


BUCKET = "CASE WHEN automation_risk_score_user IS NULL THEN 'unknown' WHEN automation_risk_score_user < 0.3 THEN 'low' WHEN automation_risk_score_user < 0.6 THEN 'medium' ELSE 'high' END"


def _categories_sql() -> str:
    dims = [("language_detected", "language_detected", "true"), ("source_container", "source_container", "true"), ("automation_risk_bucket", BUCKET, "true")]
    dims += [(f"label:{a}", c, "annotation_status = 'ok'") for a, (c, _) in LABEL_AXES.items()]
    long = " UNION ALL ".join(f"SELECT platform, week, '{d}' AS dimension, coalesce({e}, '(missing)') AS category FROM week_records WHERE {w}" for d, e, w in dims)
    return f"""{BASE}, {LEVEL}, long AS ({long}),
f AS (SELECT {LEVEL_NAME}, platform, week, dimension, category, count(*) AS n FROM long GROUP BY GROUPING SETS ((dimension, category), (dimension, category, platform), (dimension, category, week), (dimension, category, platform, week)))
SELECT *, round(n * 1.0e0 / sum(n) OVER (PARTITION BY group_level, platform, week, dimension), 4) AS proportion FROM f"""


def _missing_sql() -> str:
    cols = descriptive.NULLABLE
    parts = " UNION ALL ".join(f"SELECT group_level, platform, week, n_total, '{c}' AS \"column\", {c} AS n_missing FROM f" for c in cols)
    return f"""{BASE}, {LEVEL}, f AS (SELECT {LEVEL_NAME}, platform, week, count(*) AS n_total, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in cols)} FROM week_records GROUP BY {SETS}), l AS ({parts})
SELECT group_level, platform, week, "column", n_missing, {_share('n_missing', 'n_total')} AS missing_rate FROM l"""


def _coverage_sql() -> str:
    cols = ["n_total", "n_ok", *[f"n_{s}" for s in descriptive.NON_OK]]
    failed = " + ".join(f"coalesce(n_{s}, 0)" for s in descriptive.NON_OK)
    return f"""{BASE}, {WK}{LEVELS_GRID}{LEVEL}, f AS (SELECT {LEVEL_NAME}, platform, week, count(*) AS n_total, count(*) FILTER (WHERE annotation_status = 'ok') AS n_ok,
 {', '.join(f"count(*) FILTER (WHERE annotation_status = '{s}') AS n_{s}" for s in descriptive.NON_OK)} FROM week_records GROUP BY {SETS})
SELECT l.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in cols)}, {failed} AS n_non_ok, round(100.0e0 * ({failed}) / nullif(n_total, 0), 2) AS pct_non_ok FROM levels l LEFT JOIN f ON {SAME}"""


CELL = "platform, project_week"
COMPOSITION = {
    "platform_share": f"""{BASE}, j AS (SELECT g.*, count(content_id) AS n_platform FROM grid g LEFT JOIN ok USING ({CELL}) GROUP BY ALL),
t AS (SELECT *, (sum(n_platform) OVER (PARTITION BY project_week))::BIGINT AS n_total_week FROM j)
SELECT {CELL}, n_platform, n_total_week, {_share('n_platform', 'n_total_week')} AS platform_share, is_partial_week, {FLAGS.format(n='n_total_week')} FROM t""",
    "source_share": f"""{BASE}, c AS (SELECT {CELL}, coalesce(source_container, '(unknown)') AS source_container, count(*) AS n_source FROM records GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY n_source DESC, source_container) AS rank, (sum(n_source) OVER (PARTITION BY {CELL}))::BIGINT AS n_week FROM c),
o AS (SELECT {CELL}, is_partial_week, coalesce(max(n_week), 0) AS n_week, coalesce(sum(n_source) FILTER (WHERE rank <= 5), 0)::BIGINT AS n_top FROM grid LEFT JOIN r USING ({CELL}) GROUP BY ALL),
u AS (SELECT {CELL}, source_container, rank, n_source, r.n_week, is_partial_week FROM r JOIN grid USING ({CELL}) WHERE rank <= 5 UNION ALL SELECT {CELL}, '(others)', 6, n_week - n_top, n_week, is_partial_week FROM o)
SELECT {CELL}, source_container, rank, n_source, n_week, {_share('n_source', 'n_week')} AS source_share, is_partial_week, {FLAGS.format(n='n_week')} FROM u""",
    "language_share": f"""{BASE}, {_values('langs', 'language', LANGUAGES)}, c AS (SELECT {CELL}, language_detected AS language, count(*) AS k FROM records GROUP BY ALL), t AS (SELECT {CELL}, count(*) AS n FROM records GROUP BY ALL),
j AS (SELECT g.*, language, coalesce(k, 0) AS n_lang, coalesce(n, 0) AS n_week FROM grid g CROSS JOIN langs LEFT JOIN t USING ({CELL}) LEFT JOIN c USING ({CELL}, language))
SELECT {CELL}, language, n_lang, n_week, {_share('n_lang', 'n_week')} AS lang_share, is_partial_week, {FLAGS.format(n='n_week')} FROM j""",
    "content_type_share": f"""{BASE}, j AS (SELECT g.*, CASE WHEN content_type_label IN ('news_or_report', 'personal_opinion') THEN content_type_label ELSE '(other_types)' END AS content_type, content_id FROM grid g LEFT JOIN ok USING ({CELL})),
t AS (SELECT {CELL}, is_partial_week, content_type, count(content_id) AS k FROM j GROUP BY ALL), {_values('types', 'content_type', ('news_or_report', 'personal_opinion', '(other_types)'))},
n AS (SELECT {CELL}, sum(k)::BIGINT AS n_ok_week FROM t GROUP BY ALL),
f AS (SELECT g.*, content_type, coalesce(k, 0) AS n_type, n_ok_week FROM grid g CROSS JOIN types JOIN n USING ({CELL}) LEFT JOIN t USING ({CELL}, content_type))
SELECT {CELL}, content_type, n_type, n_ok_week, {_share('n_type', 'n_ok_week')} AS type_share, is_partial_week, {FLAGS.format(n='n_ok_week')} FROM f""",
    "query_share": f"""{BASE}, c AS (SELECT {CELL}, coalesce(query_id, '(unknown)') AS query_id, coalesce(query_version, '(unknown)') AS query_version, count(*) AS k FROM records GROUP BY ALL),
j AS (SELECT g.*, query_id, query_version, coalesce(k, 0) AS n_query, coalesce((sum(k) OVER (PARTITION BY g.platform, g.project_week))::BIGINT, 0) AS n_week FROM grid g LEFT JOIN c USING ({CELL}))
SELECT {CELL}, query_id, query_version, n_query, n_week, {_share('n_query', 'n_week')} AS query_share, is_partial_week, {FLAGS.format(n='n_week')} FROM j""",
    "duplicate_share": f"""{BASE}, j AS (SELECT g.*, count(content_id) AS n_total, count(*) FILTER (WHERE is_exact_duplicate) AS n_exact_duplicate, count(*) FILTER (WHERE is_near_duplicate) AS n_near_duplicate FROM grid g LEFT JOIN records USING ({CELL}) GROUP BY ALL)
SELECT {CELL}, n_total, n_exact_duplicate, n_near_duplicate, {_share('n_exact_duplicate', 'n_total')} AS exact_duplicate_share, {_share('n_near_duplicate', 'n_total')} AS near_duplicate_share, is_partial_week, {FLAGS.format(n='n_total')} FROM j""",
    "author_concentration": f"""{BASE}, p AS (SELECT {CELL}, author_hash, count(*) AS n FROM records GROUP BY ALL),
j AS (SELECT g.*, coalesce(sum(n), 0)::BIGINT AS n_total, count(author_hash) AS n_unique_authors, coalesce(sum(n) FILTER (WHERE author_hash IS NULL), 0)::BIGINT AS n_missing_author_hash, coalesce(max(n) FILTER (WHERE author_hash IS NOT NULL), 0) AS top_author_n FROM grid g LEFT JOIN p USING ({CELL}) GROUP BY ALL)
SELECT {CELL}, n_total, n_unique_authors, n_missing_author_hash, top_author_n, CASE WHEN top_author_n > 0 THEN {_share('top_author_n', 'n_total')} END AS top_author_share, is_partial_week, {FLAGS.format(n='n_total')} FROM j""",
    "risk_share": f"""{BASE}, b AS (SELECT *, {BUCKET} AS bucket FROM records),
j AS (SELECT g.*, count(content_id) AS n_total, count(*) FILTER (WHERE is_flagged_bot_suspect) AS n_flagged_bot, {', '.join(f"count(content_id) FILTER (WHERE bucket = '{x}') AS n_risk_{x}" for x in ('high', 'medium', 'low', 'unknown'))} FROM grid g LEFT JOIN b USING ({CELL}) GROUP BY ALL)
SELECT {CELL}, n_total, n_flagged_bot, n_risk_high, n_risk_medium, n_risk_low, n_risk_unknown, {_share('n_flagged_bot', 'n_total')} AS bot_suspect_share, {_share('n_risk_high', 'n_total')} AS risk_high_share, is_partial_week, {FLAGS.format(n='n_total')} FROM j""",
    "parent_concentration": f"""{BASE}, p AS (SELECT {CELL}, parent_id, count(*) AS n, row_number() OVER (PARTITION BY {CELL} ORDER BY count(*) DESC, parent_id) AS r FROM records WHERE parent_id IS NOT NULL GROUP BY {CELL}, parent_id),
s AS (SELECT {CELL}, source_container, count(*) AS n, row_number() OVER (PARTITION BY {CELL} ORDER BY count(*) DESC, source_container) AS r FROM records WHERE source_container IS NOT NULL GROUP BY {CELL}, source_container),
t AS (SELECT {CELL}, count(*) AS n FROM records GROUP BY ALL),
j AS (SELECT g.*, coalesce(t.n, 0) AS n_total, p.parent_id AS top_parent_id, coalesce(p.n, 0) AS top_parent_n, s.source_container AS top_container, coalesce(s.n, 0) AS top_container_n FROM grid g LEFT JOIN t USING ({CELL}) LEFT JOIN (SELECT * FROM p WHERE r = 1) p USING ({CELL}) LEFT JOIN (SELECT * FROM s WHERE r = 1) s USING ({CELL}))
SELECT {CELL}, n_total, top_parent_id, top_parent_n, CASE WHEN top_parent_n > 0 THEN {_share('top_parent_n', 'n_total')} END AS top_parent_share, top_container, top_container_n, CASE WHEN top_container_n > 0 THEN {_share('top_container_n', 'n_total')} END AS top_container_share, is_partial_week, {FLAGS.format(n='n_total')} FROM j""",
    "sentiment_adjusted": f"""{BASE}, p AS (SELECT {CELL}, author_hash, count(*) AS n, count(*) FILTER (WHERE sentiment_label = 'positive') AS k FROM ok GROUP BY ALL),
j AS (SELECT g.*, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS n_positive_raw, count(author_hash) AS n_authors_in_balanced, round(avg(k * 1.0e0 / n) FILTER (WHERE author_hash IS NOT NULL), 4) AS balanced_positive_rate FROM grid g LEFT JOIN p USING ({CELL}) GROUP BY ALL),
v AS (SELECT *, round_even(balanced_positive_rate * n_authors_in_balanced, 0)::BIGINT AS votes, {_share('n_positive_raw', 'n')} AS raw_positive_rate FROM j)
SELECT {CELL}, n, n_authors_in_balanced, n_positive_raw, raw_positive_rate, {wilson_sql('n_positive_raw', 'n', '-')} AS raw_ci_low, {wilson_sql('n_positive_raw', 'n', '+')} AS raw_ci_high, balanced_positive_rate,
 {wilson_sql('votes', 'n_authors_in_balanced', '-')} AS balanced_ci_low, {wilson_sql('votes', 'n_authors_in_balanced', '+')} AS balanced_ci_high, round(balanced_positive_rate - raw_positive_rate, 4) AS rate_delta, is_partial_week, {FLAGS.format(n='n')} FROM v""",
}


def _wilson6(k: str, n: str, sign: str) -> str:
    return wilson_sql(k, n, sign).replace(", 4) END", ", 6) END")


def _sensitivity_sql() -> str:
    rules = {"duplicate_inclusion": "NOT (is_exact_duplicate OR is_near_duplicate)", "largest_source_exclusion": "top_source IS NOT NULL AND source_container IS DISTINCT FROM top_source", "largest_parent_exclusion": "top_post IS NOT NULL AND post_id IS DISTINCT FROM top_post", "confidence_threshold": f"confidence >= {sensitivity.CONFIDENCE}"}
    left = f"n AS n_baseline, round(k * 1.0e0 / nullif(n, 0), 6) AS positive_share_baseline, {_wilson6('k', 'n', '-')} AS ci_low_baseline, {_wilson6('k', 'n', '+')} AS ci_high_baseline"
    parts = " UNION ALL ".join(f"SELECT '{r}' AS comparison_id, platform, count(content_id) AS n, count(*) FILTER (WHERE hit) AS k, count(content_id) FILTER (WHERE {w}) AS na, count(*) FILTER (WHERE ({w}) AND hit) AS ka FROM x GROUP BY platform" for r, w in rules.items())
    return f"""{BASE},
tops AS (SELECT platform, source_container AS top_source FROM (SELECT platform, source_container, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, source_container) AS r FROM ok WHERE source_container IS NOT NULL GROUP BY platform, source_container) WHERE r = 1),
topp AS (SELECT platform, post_id AS top_post FROM (SELECT platform, post_id, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, post_id) AS r FROM ok WHERE post_id IS NOT NULL GROUP BY platform, post_id) WHERE r = 1),
x AS (SELECT plats.platform, ok.* EXCLUDE (platform), top_source, top_post, sentiment_label = 'positive' AS hit FROM plats LEFT JOIN ok USING (platform) LEFT JOIN tops USING (platform) LEFT JOIN topp USING (platform)),
simple AS ({parts}),
votes AS (SELECT platform, count(*) AS na, avg(rate) AS ra FROM (SELECT platform, author_hash, count(*) FILTER (WHERE hit) * 1.0e0 / count(*) AS rate FROM x WHERE author_hash IS NOT NULL GROUP BY ALL) GROUP BY platform),
base AS (SELECT platform, count(content_id) AS n, count(*) FILTER (WHERE hit) AS k FROM x GROUP BY platform),
e AS (SELECT *, greatest(engagement_score, 0) AS g FROM x WHERE platform = '{sensitivity.WEIGHTED_PLATFORM}' AND engagement_score IS NOT NULL),
w AS (SELECT *, ln(1 + least(g, (SELECT quantile_cont(g, {sensitivity.CAP_PERCENTILE}) FROM e))) AS w FROM e),
wt AS (SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS k, sum(CASE WHEN hit THEN w ELSE 0 END) / nullif(sum(w), 0) AS ws FROM w)
SELECT comparison_id, platform, {left}, na AS n_alternative, round(ka * 1.0e0 / nullif(na, 0), 6) AS positive_share_alternative, {_wilson6('ka', 'na', '-')} AS ci_low_alternative, {_wilson6('ka', 'na', '+')} AS ci_high_alternative, round(ka * 1.0e0 / nullif(na, 0) - k * 1.0e0 / nullif(n, 0), 6) AS shift FROM simple
UNION ALL SELECT 'content_vs_author_balanced', platform, {left}, coalesce(na, 0), round(ra, 6), NULL, NULL, round(ra - k * 1.0e0 / nullif(n, 0), 6) FROM base LEFT JOIN votes USING (platform)
UNION ALL SELECT 'engagement_weighting', '{sensitivity.WEIGHTED_PLATFORM}', {left}, n, round(ws, 6), NULL, NULL, round(ws - k * 1.0e0 / nullif(n, 0), 6) FROM wt"""


def _events_sql() -> str:
    pa, pb, z = "k_before * 1.0e0 / n_before_target", "k_after * 1.0e0 / n_after_target", Z[0.95]
    known = "n_before_target > 0 AND n_after_target > 0"
    se = f"{z!r} * sqrt(({pa}) * (1 - {pa}) / n_before_target + ({pb}) * (1 - {pb}) / n_after_target)"
    return f"""{BASE}, v AS (SELECT * FROM {events.variants_sql()}),
tops AS (SELECT platform, source_container AS top_source FROM (SELECT platform, source_container, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, source_container) AS r FROM ok WHERE source_container IS NOT NULL GROUP BY platform, source_container) WHERE r = 1),
j AS (SELECT v.event_id, v.variant, v.stance, v.window_days, p.platform, o.content_id, o.created_at < v.t1 AS b, o.target = v.event_target AS t, o.stance_label = v.stance AS s
 FROM v CROSS JOIN plats p LEFT JOIN tops USING (platform) LEFT JOIN ok o ON o.platform = p.platform AND o.created_at >= v.t0 AND o.created_at < v.t2 AND (NOT v.no_dup OR NOT o.is_near_duplicate) AND (NOT v.no_top OR top_source IS NULL OR coalesce(o.source_container, '') <> top_source)),
c AS (SELECT event_id, variant, stance, window_days, platform, count(content_id) FILTER (WHERE b) AS n_before_all, count(content_id) FILTER (WHERE NOT b) AS n_after_all, count(*) FILTER (WHERE b AND t) AS n_before_target, count(*) FILTER (WHERE NOT b AND t) AS n_after_target, count(*) FILTER (WHERE b AND t AND s) AS k_before, count(*) FILTER (WHERE NOT b AND t AND s) AS k_after FROM j GROUP BY ALL)
SELECT event_id, variant, platform, window_days::INT AS window_days, stance, CASE WHEN {known} THEN round({pa}, 6) END AS p_before, CASE WHEN {known} THEN round({pb}, 6) END AS p_after, CASE WHEN {known} THEN round({pb} - {pa}, 6) END AS share_diff,
 CASE WHEN {known} THEN round({pb} - {pa} - {se}, 6) END AS ci_low, CASE WHEN {known} THEN round({pb} - {pa} + {se}, 6) END AS ci_high, n_before_all, n_after_all, n_before_target, n_after_target FROM c"""


EVENT_COMPOSITION = f"""{BASE}, v AS (SELECT * FROM {events.variants_sql()}), m AS (SELECT * FROM v WHERE variant = 'main'), {_values('sides', 'side', ('before', 'after'))},
c AS (SELECT m.event_id, CASE WHEN created_at < t1 THEN 'before' ELSE 'after' END AS side, platform, count(*) AS k FROM m JOIN ok ON created_at >= t0 AND created_at < t2 GROUP BY ALL),
f AS (SELECT m.event_id, side, platform, coalesce(k, 0) AS n_records FROM m CROSS JOIN sides CROSS JOIN plats LEFT JOIN c USING (event_id, side, platform))
SELECT *, (sum(n_records) OVER (PARTITION BY event_id, side))::BIGINT AS total_records_in_window, round(n_records * 1.0e0 / nullif(sum(n_records) OVER (PARTITION BY event_id, side), 0), 6) AS platform_share FROM f"""

ANCHOR = f"""{BASE}, a AS (SELECT * FROM ok WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-17')
SELECT platform, count(content_id) AS n_records, round(avg((sentiment_label = 'negative')::INT), 6) AS negative_sentiment_share, round(avg((emotion_label = 'anger')::INT), 6) AS anger_share, round(avg((emotion_label = 'fear')::INT), 6) AS fear_share FROM plats LEFT JOIN a USING (platform) GROUP BY platform"""


def _on_records(f, *args):
    return lambda spark, sf_dir: f(records(spark, sf_dir), *args)


QUERIES = {"weekly_class_trend": (_on_records(trend.class_trend, *LABEL_AXES["sentiment"]), _trend_sql(*LABEL_AXES["sentiment"]))}
for _axis in ("stance", "emotion", "content_type"):
    QUERIES[f"weekly_{_axis}_trend"] = (_on_records(trend.class_trend, *LABEL_AXES[_axis]), _trend_sql(*LABEL_AXES[_axis]))
QUERIES |= {
    "weekly_outcomes": (_on_records(trend.weekly_outcomes), _outcomes_sql()),
    "descriptive_summary": (_on_records(descriptive.summary), _summary_sql()),
    "category_shares": (_on_records(descriptive.category_shares), _categories_sql()),
    "missing_rates": (_on_records(descriptive.missing_rates), _missing_sql()),
    "annotation_coverage": (_on_records(descriptive.annotation_coverage), _coverage_sql()),
    **{f"composition_{name}": (_on_records(getattr(composition, name)), sql) for name, sql in COMPOSITION.items()},
    "sensitivity_comparisons": (_on_records(sensitivity.comparisons), _sensitivity_sql()),
    "event_before_after": (_on_records(events.before_after), _events_sql()),
    "event_composition": (_on_records(events.composition), EVENT_COMPOSITION),
    "event_anchor": (_on_records(events.anchor), ANCHOR),
}
