"""Market series: transforms, panel, weekly returns and coverage, event windows, alignment.

The canonical form is long: (observation_date, asset_id, value). Differences are
per observation, correlations per calendar day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.stats import correlation

VOLATILITY_ROWS = 10


def _by_date():
    return Window.partitionBy("asset_id").orderBy("observation_date")


def changes(series: DataFrame) -> DataFrame:
    """Adds transform and change: log differences where all values are positive, first differences else, none under three observations."""
    known = series.filter(F.col("value").isNotNull())
    per = Window.partitionBy("asset_id")
    kind = F.when(F.count("*").over(per) < 3, "none").when(F.min("value").over(per) > 0, "log_return").otherwise("first_difference")
    out = known.withColumn("transform", kind)
    change = F.when(F.col("transform") == "log_return", F.ln("value") - F.lag(F.ln(F.greatest("value", F.lit(1e-300)))).over(_by_date())).when(F.col("transform") == "first_difference", F.col("value") - F.lag("value").over(_by_date()))
    return out.withColumn("change", change)


def rolling_volatility(series: DataFrame, rows: int = VOLATILITY_ROWS, periods: int = 252) -> DataFrame:
    """Annualised deviation of the last ``rows`` changes, once there are as many."""
    last = _by_date().rowsBetween(-(rows - 1), 0)
    out = changes(series).filter(F.col("change").isNotNull())
    return out.select("observation_date", "asset_id", F.when(F.count("change").over(last) == rows, F.stddev_samp("change").over(last) * (periods**0.5)).alias("volatility"))


def basket(series: DataFrame) -> DataFrame:
    """Mean of the members relative to their values on the first day that all have one."""
    days = series.filter(F.col("value").isNotNull()).groupBy("observation_date").agg(F.count_distinct("asset_id").alias("k"))
    members = series.agg(F.count_distinct("asset_id").alias("m"))
    base_day = days.crossJoin(F.broadcast(members)).filter("k = m").agg(F.min("observation_date").alias("base_date"))
    base = series.join(F.broadcast(base_day), F.col("observation_date") == F.col("base_date")).select("asset_id", F.col("value").alias("base"))
    return series.join(F.broadcast(base), "asset_id").groupBy("observation_date").agg(F.avg(100 * F.col("value") / F.col("base")).alias("basket"), F.count("value").alias("n_members"))


def spread(series: DataFrame, a: str, b: str) -> DataFrame:
    """value of a minus value of b on their common days."""
    x, y = series.filter(F.col("asset_id") == a).select("observation_date", F.col("value").alias("x")), series.filter(F.col("asset_id") == b).select("observation_date", F.col("value").alias("y"))
    return x.join(y, "observation_date").select("observation_date", (F.col("x") - F.col("y")).alias("spread"))


def calendar_panel(series: DataFrame) -> DataFrame:
    """Every asset on every day, with the reason of each hole: Friday, market closed (no asset at all), before first, after last, or missing."""
    ends = series.agg(F.min("observation_date").alias("a"), F.max("observation_date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("observation_date"))
    names = series.groupBy("asset_id").agg(F.min("observation_date").alias("first"), F.max("observation_date").alias("last"))
    open_days = series.select(F.col("observation_date").alias("open_day")).distinct()
    grid = days.crossJoin(F.broadcast(names)).join(F.broadcast(open_days), F.col("observation_date") == F.col("open_day"), "left").join(series, ["observation_date", "asset_id"], "left")
    reason = F.when(F.col("value").isNotNull(), "observed").when(F.dayofweek("observation_date") == 6, "friday").when(F.col("open_day").isNull(), "market_closed").when(F.col("observation_date") < F.col("first"), "before_first").when(F.col("observation_date") > F.col("last"), "after_last").otherwise("missing")
    return grid.select("observation_date", "asset_id", "value", reason.alias("reason"), F.col("open_day").isNotNull().alias("market_open"))


def week_of(day: Column, start: str) -> Column:
    return F.floor(F.datediff(day, F.lit(start).cast("date")) / 7) + 1


def weekly_returns(series: DataFrame, start: str) -> DataFrame:
    """Sum of log changes by week and asset, as a simple change too, with first and last day."""
    c = changes(series).filter(F.col("change").isNotNull() & (F.col("transform") == "log_return"))
    return c.groupBy(week_of(F.col("observation_date"), start).alias("week"), "asset_id").agg(F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), F.count("*").alias("n_return_obs"), F.round(F.sum("change"), 8).alias("weekly_log_change"), F.round(F.expm1(F.sum("change")), 8).alias("weekly_simple_change"))


def weekly_coverage(series: DataFrame, start: str, enough: float = 0.6) -> DataFrame:
    """Open and observed days by week and asset, their ratio and a status."""
    p = calendar_panel(series).withColumn("week", week_of(F.col("observation_date"), start))
    cells = p.groupBy("week", "asset_id").agg(F.count_if("market_open").alias("open_days"), F.count("value").alias("observed_days"), F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))
    ratio = F.try_divide(F.col("observed_days").cast("double"), F.col("open_days"))
    status = F.when(F.col("open_days") == 0, "market_closed").when(F.col("observed_days") == 0, "no_data").when(ratio < enough, "partial").otherwise("ok")
    return cells.select("week", "asset_id", "open_days", "observed_days", F.round(ratio, 6).alias("coverage_ratio"), "reasons", status.alias("status"))


def coverage_summary(series: DataFrame, start: str) -> DataFrame:
    """By asset: first and last observation, weeks, least and median ratio, eligibility."""
    first = series.filter(F.col("value").isNotNull()).groupBy("asset_id").agg(F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"))
    w = weekly_coverage(series, start).filter("open_days > 0").groupBy("asset_id").agg(F.count("*").alias("n_weeks"), F.round(F.min("coverage_ratio"), 6).alias("min_ratio"), F.round(F.percentile("coverage_ratio", F.lit(0.5)), 6).alias("median_ratio"))
    return w.join(first, "asset_id").withColumn("is_eligible", F.col("median_ratio") >= 0.6)


def weekly_last(series: DataFrame, start: str) -> DataFrame:
    """The last value that is not null of each week and asset."""
    return series.groupBy(week_of(F.col("observation_date"), start).alias("week"), "asset_id").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("observation_date"))).alias("last_value"))


def observation_counts(series: DataFrame, start: str, assets: list[str]) -> DataFrame:
    """Weeks by assets, as columns in the order given."""
    return series.withColumn("week", week_of(F.col("observation_date"), start)).groupBy("week").pivot("asset_id", assets).count().na.fill(0)


def event_windows(series: DataFrame, events: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Rows around each event by position: ``before`` ahead of the first observation on or after its date, and ``after`` from it."""
    ranked = series.filter(F.col("value").isNotNull()).withColumn("pos", F.row_number().over(_by_date()))
    e = F.broadcast(events.select("event_id", "event_date"))
    at = ranked.join(e, F.col("observation_date") >= F.col("event_date")).groupBy("event_id", "asset_id").agg(F.min("pos").alias("p0"))
    near = ranked.join(F.broadcast(at), "asset_id").filter((F.col("pos") >= F.col("p0") - before) & (F.col("pos") < F.col("p0") + after))
    return near.select("event_id", "asset_id", (F.col("pos") - F.col("p0")).cast("long").alias("offset"), "observation_date", "value")


def cross_check(series: DataFrame, a: str, b: str, level_tolerance: float = 0.02, least_corr: float = 0.9) -> DataFrame:
    """Two sources of one thing on their common days: median relative difference, or correlation and sign agreement of changes."""
    c = changes(series)
    x = c.filter(F.col("asset_id") == a).select("observation_date", F.col("value").alias("x"), F.col("change").alias("dx"))
    y = c.filter(F.col("asset_id") == b).select("observation_date", F.col("value").alias("y"), F.col("change").alias("dy"))
    j = x.join(y, "observation_date").agg(F.count("*").alias("n_common"), F.percentile(F.abs(F.col("x") - F.col("y")) / F.col("y"), F.lit(0.5)).alias("d"), correlation("dx", "dy").alias("r"), F.avg((F.signum("dx") == F.signum("dy")).cast("double")).alias("s"))
    status = F.when(F.col("d") < level_tolerance, "level_match").when((F.col("r") >= least_corr) & (F.col("s") >= least_corr), "return_match").otherwise("mismatch")
    return j.select("n_common", F.round("d", 6).alias("median_relative_difference"), F.round("r", 6).alias("return_correlation"), F.round("s", 6).alias("same_sign_share"), status.alias("status"))


def lag_correlations(series: DataFrame, lags=(0, 1, 3, 7), least: int = 30) -> DataFrame:
    """Correlation of each pair's changes at calendar lags: a positive lag says the first leads."""
    c = changes(series).filter(F.col("change").isNotNull()).select("asset_id", "observation_date", "change")
    x = c.toDF("x_asset", "x_date", "x").crossJoin(F.broadcast(c.sparkSession.createDataFrame([(v,) for v in lags], "lag int"))).withColumn("observation_date", F.date_add("x_date", F.col("lag")))
    y = c.toDF("y_asset", "observation_date", "y")
    j = x.join(y, "observation_date").filter("x_asset <> y_asset")
    return j.groupBy("x_asset", "y_asset", "lag").agg(F.count("*").alias("n"), F.round(correlation("x", "y"), 6).alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def spearman(pairs: DataFrame, *by: str) -> DataFrame:
    """Rank correlation of x and y with average ranks of ties."""
    def rank(c: str) -> Column:
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return pairs.withColumns({"rx": rank("x"), "ry": rank("y")}).groupBy(*by).agg(F.count("*").alias("n"), F.round(correlation("rx", "ry"), 6).alias("spearman"))


def week_lag_join(outcomes: DataFrame, returns: DataFrame, lags=(0, 1, 2)) -> DataFrame:
    """Outcomes of a week beside the returns of the same and later weeks."""
    long = outcomes.crossJoin(F.broadcast(outcomes.sparkSession.createDataFrame([(v,) for v in lags], "lag int"))).withColumn("fin_week", F.col("week") + F.col("lag"))
    return long.join(returns.withColumnRenamed("week", "fin_week"), "fin_week")


def benjamini_hochberg(tests: DataFrame, family: str = "family", p: str = "p_value") -> DataFrame:
    """Adds q_value: the running minimum, from the largest p down, of p * m / rank."""
    m = F.count("*").over(Window.partitionBy(family))
    rank = F.row_number().over(Window.partitionBy(family).orderBy(p, "test_id"))
    down = Window.partitionBy(family).orderBy(F.desc(p), F.desc("test_id")).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("__r", F.col(p) * m / rank).withColumn("q_value", F.round(F.least(F.lit(1.0), F.min("__r").over(down)), 6)).drop("__r")


#: Values that are shuffled at once.
SHUFFLED = 1 << 20


def permutation_p(pairs: DataFrame, by: str, n: int = 9999, seed: int = 1405) -> DataFrame:
    """(by, n_pairs, r, p_value) by shuffling y; a test is one short series, so one group a task."""
    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        rng = np.random.default_rng(seed)
        if len(x) < 3 or x.std() == 0 or y.std() == 0:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "n_pairs": [len(x)], "r": [None], "p_value": [None]})
        r = np.corrcoef(x, y)[0, 1]
        dx, dy = (x - x.mean()) / (x.std() * len(x)), (y - y.mean()) / y.std()
        hits, each = 0, max(1, SHUFFLED // len(y))
        for first in range(0, n, each):
            shuffled = rng.permuted(np.broadcast_to(dy, (min(each, n - first), len(dy))), axis=1)
            hits += int((abs(shuffled @ dx) >= abs(r) - 1e-12).sum())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n_pairs": [len(x)], "r": [r], "p_value": [(hits + 1) / (n + 1)]})

    return pairs.groupBy(by).applyInPandas(test, f"{by} string, n_pairs long, r double, p_value double")


def stationarity(series: DataFrame, least: int = 25, lags: int = 1) -> DataFrame:
    """(asset_id, n, adf_t, kpss, verdict): a unit-root and a stationarity statistic against their 5 % values."""
    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("observation_date")["value"].dropna().to_numpy(float)
        name = pdf["asset_id"].iloc[0]
        if len(y) < least or y.std() == 0:
            return pd.DataFrame({"asset_id": [name], "n": [len(y)], "adf_t": [None], "kpss": [None], "verdict": ["insufficient"]})
        d = np.diff(y)
        cols = [np.ones(len(d) - lags), y[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))]
        x, target = np.column_stack(cols), d[lags:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rest = target - x @ beta
        cov = np.linalg.inv(x.T @ x) * (rest @ rest) / (len(target) - x.shape[1])
        adf = float(beta[1] / np.sqrt(cov[1, 1]))
        e = y - y.mean()
        width = int(np.ceil(12 * (len(y) / 100) ** 0.25))
        long_run = e @ e / len(y) + 2 * sum((1 - k / (width + 1)) * (e[k:] @ e[:-k]) / len(y) for k in range(1, width + 1))
        kpss = float((np.cumsum(e) ** 2).sum() / len(y) ** 2 / long_run)
        # 5 % critical values (fixed values): -2.86 with a constant, 0.463 around a level.
        verdict = {(True, True): "stationary", (False, False): "unit_root", (True, False): "difference_stationary", (False, True): "inconclusive"}[adf < -2.86, kpss < 0.463]
        return pd.DataFrame({"asset_id": [name], "n": [len(y)], "adf_t": [adf], "kpss": [kpss], "verdict": [verdict]})

    return series.groupBy("asset_id").applyInPandas(test, "asset_id string, n long, adf_t double, kpss double, verdict string")
