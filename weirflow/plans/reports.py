"""Queries behind reports, with SQL twins."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.operators import reports
from weirflow.plans import markets, texts, weekly
from weirflow.sources.bindings import ASSETS_SQL, PLATFORMS, RECORDS_SQL, SENTIMENTS, assets, records, table


def _side(s, d, name, columns):
    return table(s, d, name).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _sql(name, source, columns):
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


GEO = {
    "video_id": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('t', cast(c_custkey % 90 as string)) END",
    "country": "concat('n', cast(c_nationkey as string))",
    "file_no": "c_custkey % 2",
    "line_no": "c_custkey",
}
POSTS = {"post_id": "concat('t', cast(o_orderkey as string))", "author_hash": "concat('u', cast(o_custkey as string))", "title": "o_orderstatus"}
PROVENANCE = {"post_id": "concat('t', cast(p_partkey as string))", "query_id": "p_brand", "subreddit": "p_type"}
FETCHED = {"post_id": "concat('t', cast(s_suppkey as string))", "finished_s": "s_suppkey * 60"}


def _post_context(s, d):
    rows = records(s, d).select("content_id", "post_id", "author_hash", "query_id")
    rows = reports.with_geo(rows, _side(s, d, "customer", GEO))
    rows = reports.with_lookup(rows, _side(s, d, "orders", POSTS), "post_id", "_post")
    rows = reports.with_lookup(rows, _side(s, d, "part", PROVENANCE), "post_id", "_provenance")
    return reports.with_lookup(rows, _side(s, d, "supplier", FETCHED), "post_id")


CONTEXT_SQL = f"""WITH {RECORDS_SQL}, {_sql('geo', 'customer', GEO)}, {_sql('posts', 'orders', POSTS)}, {_sql('prov', 'part', PROVENANCE)}, {_sql('fetched', 'supplier', FETCHED)},
g AS (SELECT video_id AS post_id, country AS video_geo FROM geo WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY file_no DESC, line_no DESC) = 1)
SELECT r.content_id, r.post_id, r.author_hash, r.query_id, video_geo, p.author_hash AS author_hash_post, title, v.query_id AS query_id_provenance, subreddit, finished_s
FROM records r LEFT JOIN g USING (post_id) LEFT JOIN posts p USING (post_id) LEFT JOIN prov v USING (post_id) LEFT JOIN fetched USING (post_id)"""


def _scored(s, d):
    rows = texts.comments(s, d).select("content_id", "author")
    return reports.with_user_scores(rows, texts._users(s, d))


_US = f"us AS ({texts.USERS_SQL})"
SCORED_SQL = f"WITH {texts.COMMENTS_SQL}, {_US} SELECT content_id, c.author, automation_risk_score_user, coalesce(is_flagged_bot_suspect, false) AS is_flagged_bot_suspect FROM comments c LEFT JOIN us ON c.author = us.author"
TOTALS_SQL = f"""WITH {RECORDS_SQL}, {_US}
SELECT 'records' AS metric, 'all' AS platform, count(*)::DOUBLE AS value FROM records UNION ALL SELECT 'records', coalesce(platform, 'unknown'), count(*) FROM records GROUP BY platform
UNION ALL SELECT 'users', 'all', count(*) FROM us UNION ALL SELECT 'flagged_users', 'all', count(*) FILTER (WHERE is_flagged_bot_suspect) FROM us
UNION ALL SELECT 'flagged_pct', 'all', coalesce(round(100.0e0 * count(*) FILTER (WHERE is_flagged_bot_suspect) / nullif(count(*), 0), 1), 0) FROM us"""


def _marked(s, d):
    """The users with a lower bar for the flag, so that the list is longer than its cut."""
    return texts._users(s, d).withColumn("is_flagged_bot_suspect", F.col("automation_risk_score_user") >= 0.1)


FLAGGED_SQL = f"WITH {_US} SELECT author, automation_risk_score_user, total_interactions, exact_duplicate_ratio, url_interaction_ratio, hour_coverage_ratio FROM us WHERE automation_risk_score_user >= 0.1 ORDER BY automation_risk_score_user DESC, author LIMIT {reports.TOP_USERS}"
_MISSING, _MISSING_SQL = weekly.QUERIES["missing_rates"]
MISSING_SQL = f"""WITH mr AS ({_MISSING_SQL}) SELECT "column", missing_rate FROM mr WHERE group_level = 'overall' ORDER BY missing_rate DESC, "column" LIMIT {reports.TOP_COLUMNS}"""
P_SQL = f"WITH bh AS ({markets.BH_SQL}) SELECT * FROM bh ORDER BY p_value, family, test_id LIMIT {reports.TOP_TESTS}"

#: The window of the chosen features, and the choice: a column, two assets of one column, and one left out.
STUDY = ProjectCalendar(datetime(1996, 1, 1, tzinfo=UTC), datetime(1996, 12, 29, 23, 59, 59, tzinfo=UTC))
CHOSEN = [("urgent", "f_urgent", "core", "primary"), ("high", "f_high", "core", "primary"), ("high_again", "f_high", "support", "robustness")]
_WIDE = {"f_urgent": "1-URGENT", "f_high": "2-HIGH", "f_low": "5-LOW"}


def _selected(s, d):
    series = assets(s, d)
    wide = series.groupBy("observation_date").agg(*[F.max(F.when(F.col("asset_id") == a, F.round("value", 6))).alias(c) for c, a in _WIDE.items()])
    decisions = s.createDataFrame(CHOSEN, "asset_id string, feature_column string, analysis_tier string, analysis_use string")
    return reports.selected_features(wide, decisions, STUDY).withColumn("observation_date", F.col("observation_date").cast("string"))


SELECTED_SQL = f"""WITH {ASSETS_SQL}, wide AS (SELECT observation_date, {', '.join(f"max(CASE WHEN asset_id = '{a}' THEN round(value, 6) END) AS {c}" for c, a in _WIDE.items())} FROM assets GROUP BY 1),
long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (daily_log_change FOR feature_column IN ({', '.join(_WIDE)}))),
dec AS (SELECT * FROM (VALUES {', '.join(map(str, CHOSEN))}) AS v(asset_id, feature_column, analysis_tier, analysis_use))
SELECT observation_date::VARCHAR AS observation_date, {STUDY.week_sql('observation_date::TIMESTAMP')} AS project_week, asset_id, analysis_tier, analysis_use, feature_column, daily_log_change
FROM long JOIN dec USING (feature_column) WHERE observation_date BETWEEN DATE '{STUDY.start:%Y-%m-%d}' AND DATE '{STUDY.end:%Y-%m-%d}'"""

REGISTRY = {"position": "n_nationkey", "query_id": "concat('Q', cast(n_nationkey as string))", "family": "concat('F', cast(n_regionkey as string))", "lang": "CASE WHEN n_regionkey = 2 THEN 'en' WHEN n_nationkey % 3 = 0 THEN 'fa' ELSE 'en' END"}
_IDS = "coalesce(string_agg(query_id, ', ' ORDER BY position) FILTER (WHERE lang = '{x}'), '—')"
_MARK = "CASE WHEN bool_or(lang = '{x}') THEN '✓' ELSE '—' END"
FAMILIES_SQL = f"""WITH {_sql('q', 'nation', REGISTRY)} SELECT family, {_MARK.format(x='en')} AS en, {_MARK.format(x='fa')} AS fa, {_IDS.format(x='en')} AS en_query_ids, {_IDS.format(x='fa')} AS fa_query_ids,
count(*) AS n_queries, {len(PROJECT.labels)}::BIGINT AS weeks_per_query, count(*) * {len(PROJECT.labels)} AS initial_jobs FROM q GROUP BY family"""

_ORDER = PLATFORMS[::-1][:2]


def _ordered(s, d):
    cells = records(s, d).groupBy("platform", "project_week", "sentiment_label").agg(F.count("*").alias("n"))
    # The cells are as many as platforms x weeks x labels, however many records there are.
    order = Window.orderBy(reports.place_in(F.col("platform"), _ORDER), F.asc_nulls_last(reports.week_number(F.col("project_week"))), reports.place_in(F.col("sentiment_label"), SENTIMENTS))
    return cells.withColumn("place", F.row_number().over(order).cast("long"))


def _place(c, values):
    return f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(values, 1)) + f" ELSE {len(values) + 1} END"


ORDERED_SQL = f"""WITH {RECORDS_SQL}, cells AS (SELECT platform, project_week, sentiment_label, count(*) AS n FROM records GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY {_place('platform', _ORDER)}, TRY_CAST(substr(project_week, 2) AS INT) NULLS LAST, {_place('sentiment_label', SENTIMENTS)}) AS place FROM cells"""

QUERIES = {
    "post_context": (_post_context, CONTEXT_SQL),
    "records_with_user_scores": (_scored, SCORED_SQL),
    "cleaning_totals": (lambda s, d: reports.cleaning_totals(records(s, d), texts._users(s, d)), TOTALS_SQL),
    "flagged_users": (lambda s, d: reports.flagged_users(_marked(s, d)), FLAGGED_SQL),
    "most_missing_columns": (lambda s, d: reports.most_missing(_MISSING(s, d)), MISSING_SQL),
    "least_p_values": (lambda s, d: reports.least_p_values(markets._bh(s, d)), P_SQL),
    "selected_features": (_selected, SELECTED_SQL),
    "plan_families": (lambda s, d: reports.plan_families(_side(s, d, "nation", REGISTRY), len(PROJECT.labels)), FAMILIES_SQL),
    "ordered_cells": (_ordered, ORDERED_SQL),
}
