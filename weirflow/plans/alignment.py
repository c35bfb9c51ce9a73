"""Alignment of weekly outcomes with market returns, with the SQL twin of all that is not drawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import alignment, finance
from weirflow.plans.markets import RET, START, WEEK
from weirflow.sources.bindings import assets, table

#: The use of each asset in the tests; the fifth is in none.
USES = {"1-URGENT": "main", "2-HIGH": "main", "3-MEDIUM": "sensitivity", "5-LOW": "sensitivity"}


def _social(s, d):
    """Weekly discount and share of returns of shipped lines, by line status; six places, so that engines agree on ties."""
    lines = table(s, d, "lineitem")
    week = finance.week_of(F.to_date("l_shipdate"), START).cast("int").alias("week")
    cells = lines.groupBy(F.col("l_linestatus").alias("platform"), week).agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("returned"))
    return cells.unpivot(["platform", "week"], ["discount", "returned"], "outcome_id", "outcome_value").withColumn("target_id", F.lit("all"))


def _returns(s, d):
    use = F.coalesce(*[F.when(F.col("asset_id") == a, u) for a, u in USES.items()])
    weekly = finance.weekly_returns(assets(s, d), START)
    return weekly.select(F.col("week").cast("int").alias("week"), "asset_id", use.alias("analysis_use"), F.round("weekly_simple_change", 6).alias("value")).filter("analysis_use IS NOT NULL")


def _coefficients(s, d):
    return alignment.coefficients(_social(s, d), _returns(s, d)).drop("xs", "ys").withColumn("coefficient", F.round("coefficient", 6))


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


_METHODS = [(v, use, m, week) for v, use, methods, week in alignment.VARIANTS for m in methods]
_KEYS = "platform, outcome_id, target_id, variant, asset_id, use, lag, method"
COEFFICIENTS_SQL = f"""{RET}, cells AS (SELECT l_linestatus AS platform, {WEEK.replace('observation_date', 'l_shipdate::DATE')} AS week, round(avg(l_discount), 6) AS discount, round(avg((l_returnflag = 'R')::INT), 6) AS returned FROM lineitem GROUP BY ALL),
soc AS (SELECT platform, week, 'discount' AS outcome_id, 'all' AS target_id, discount AS x FROM cells UNION ALL SELECT platform, week, 'returned', 'all', returned FROM cells),
fin AS (SELECT week AS fw, asset_id, u.use AS use, round(weekly_simple_change, 6) AS y FROM ret JOIN (VALUES {_values(USES.items())}) AS u(a, use) ON a = asset_id),
va AS (SELECT * FROM (VALUES {_values(_METHODS)}) AS v(variant, use, method, without) CROSS JOIN (VALUES {_values((k,) for k in alignment.LAGS)}) AS l(lag)),
keys AS (SELECT {_KEYS} FROM (SELECT DISTINCT platform, outcome_id, target_id FROM soc) CROSS JOIN (SELECT DISTINCT asset_id, use FROM fin) JOIN va USING (use)),
p AS (SELECT platform, outcome_id, target_id, variant, asset_id, use, lag, method, x, y FROM soc JOIN (SELECT * FROM fin JOIN va USING (use)) AS f ON f.fw - f.lag = soc.week WHERE x IS NOT NULL AND y IS NOT NULL AND (without IS NULL OR (fw <> without AND soc.week <> without))),
r AS (SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY x) + (count(*) OVER (PARTITION BY {_KEYS}, x) - 1) / 2.0e0 AS rx, rank() OVER (PARTITION BY {_KEYS} ORDER BY y) + (count(*) OVER (PARTITION BY {_KEYS}, y) - 1) / 2.0e0 AS ry FROM p),
c AS (SELECT {_KEYS}, count(*) AS n, min(x) < max(x) AND min(y) < max(y) AND count(*) >= {alignment.MIN_PAIRED_WEEKS} AS able, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(CASE method WHEN 'pearson' THEN corr(x, y) ELSE corr(rx, ry) END, 6) END AS k FROM r GROUP BY {_KEYS})
SELECT platform, outcome_id, target_id, variant AS analysis_variant, asset_id, use AS asset_analysis_use, lag AS financial_lag_weeks, CASE WHEN variant = 'primary_all_weeks' AND method = 'spearman' THEN 'primary_spearman' ELSE variant || '_' || method END AS test_family,
method, coalesce(n, 0) AS n_paired_weeks, CASE WHEN able THEN k END AS coefficient, CASE WHEN able THEN '{alignment.DONE}' ELSE '{alignment.REFUSED}' END AS status FROM keys LEFT JOIN c USING ({_KEYS})"""

QUERIES = {
    "alignment_coefficients": (_coefficients, COEFFICIENTS_SQL),
    "social_financial_alignment": (lambda s, d: alignment.alignment(_social(s, d), _returns(s, d)), None),
}
