"""Alignment of weekly social outcomes with weekly market returns: variants x outcomes x assets x lags x methods.

The pairs are ranked and correlated in the JVM; only intervals and p-values, which come
from resampling, are drawn in Python, one row a test. A test's series is no longer than the calendar.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.stats import correlation
from weirflow.operators.finance import SHUFFLED, benjamini_hochberg

# Variants with the use of their assets, their methods and the week they leave out; lags; least pairs; draws.
VARIANTS = (
    ("primary_all_weeks", "main", ("spearman", "pearson"), None),
    ("sensitivity_exclude_w21", "main", ("spearman",), 21),
    ("sensitivity_alternative_assets", "sensitivity", ("spearman",), None),
)
LAGS = (0, 1, 2)
MIN_PAIRED_WEEKS = 10
N_PERMUTATIONS, N_BOOTSTRAP = 9999, 2000
DONE, REFUSED = "exploratory_association_not_causal", "insufficient_or_constant"

SOCIAL = ["platform", "outcome_id", "target_id"]
TEST = [*SOCIAL, "analysis_variant", "asset_id", "asset_analysis_use", "financial_lag_weeks"]


def _mean_rank(c: str) -> Column:
    ties = F.count("*").over(Window.partitionBy(*TEST, c))
    return F.rank().over(Window.partitionBy(*TEST).orderBy(c)) + (ties - 1) / 2


def coefficients(social: DataFrame, returns: DataFrame) -> DataFrame:
    """The tests with their coefficients: ``TEST``, test_family, method, n_paired_weeks, coefficient, status, and the pairs as xs and ys.

    ``social`` is (platform, outcome_id, target_id, week, outcome_value), ``returns`` (week, asset_id, analysis_use, value), weeks as
    numbers. A lag of k sets a week's outcome beside the return k weeks later. Pairs without both values do not count; a test of
    too few pairs, or with a constant side, is refused and stays as a row.
    """
    spark = social.sparkSession
    variants = spark.createDataFrame([(v, use, list(methods), week) for v, use, methods, week in VARIANTS], "analysis_variant string, asset_analysis_use string, methods array<string>, without int")
    lags = F.explode(F.array(*map(F.lit, LAGS))).alias("financial_lag_weeks")
    shifted = returns.join(F.broadcast(variants), F.col("analysis_use") == F.col("asset_analysis_use")).select("analysis_variant", "asset_analysis_use", "asset_id", "methods", "without", F.col("week").alias("fin_week"), F.col("value").alias("y"), lags)
    shifted = shifted.withColumn("week", F.col("fin_week") - F.col("financial_lag_weeks"))
    counts = (F.col("fin_week") != F.col("without")) & (F.col("week") != F.col("without")) | F.col("without").isNull()
    pairs = social.withColumnRenamed("outcome_value", "x").join(shifted.filter(counts), "week").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = pairs.select(*TEST, "week", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"rx": _mean_rank("x"), "ry": _mean_rank("y")})

    def series(x: str, y: str) -> Column:
        return F.array_sort(F.collect_list(F.struct("week", F.col(x).alias("x"), F.col(y).alias("y"))))

    constant = (F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))
    found = ranked.groupBy(*TEST).agg(F.count("*").alias("n"), constant.alias("constant"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"), series("x", "y").alias("pairs"))
    # Every outcome meets every asset, lag and method, paired or not: both sides are lists of names, as long as their registries.
    tests = social.select(*SOCIAL).distinct().crossJoin(shifted.select("analysis_variant", "asset_analysis_use", "asset_id", "financial_lag_weeks", "methods").distinct())
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in TEST]
    all_tests = tests.alias("t").join(found.alias("f"), same, "left").select(*[f"t.{c}" for c in TEST], F.explode("methods").alias("method"), F.coalesce("n", F.lit(0)).alias("n_paired_weeks"), "constant", "pearson", "spearman", "pairs")
    able = (F.col("n_paired_weeks") >= MIN_PAIRED_WEEKS) & ~F.col("constant")
    primary = (F.col("analysis_variant") == "primary_all_weeks") & (F.col("method") == "spearman")
    return all_tests.select(
        *TEST,
        F.when(primary, "primary_spearman").otherwise(F.concat_ws("_", "analysis_variant", "method")).alias("test_family"),
        "method",
        "n_paired_weeks",
        F.when(able, F.when(F.col("method") == "pearson", F.col("pearson")).otherwise(F.col("spearman"))).alias("coefficient"),
        F.when(able, DONE).otherwise(REFUSED).alias("status"),
        F.when(able, F.col("pairs.x")).alias("xs"),
        F.when(able, F.col("pairs.y")).alias("ys"),
    )


def _ranks(a: np.ndarray) -> np.ndarray:
    return pd.DataFrame(a).rank(axis=1).to_numpy()


def _correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y; NaN where a row is constant."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def resampled(x: np.ndarray, y: np.ndarray, method: str, seed: int, permutations: int = N_PERMUTATIONS, draws: int = N_BOOTSTRAP) -> tuple[float, float, float]:
    """(p, low, high): by shuffling y, and the 95 % percentile interval of resampled weeks."""
    rng, each = np.random.default_rng(seed), max(1, SHUFFLED // len(x))
    # A shuffle of values shuffles their ranks.
    rx, ry = (_ranks(x[None]), _ranks(y[None])) if method == "spearman" else (x[None], y[None])
    seen, hits = abs(_correlations(rx, ry)[0]) - 1e-12, 0
    for first in range(0, permutations, each):
        shuffled = rng.permuted(np.broadcast_to(ry, (min(each, permutations - first), len(x))), axis=1)
        hits += int((abs(_correlations(rx, shuffled)) >= seen).sum())
    drawn = []
    for first in range(0, draws, each):
        at = rng.integers(0, len(x), (min(each, draws - first), len(x)))
        bx, by = x[at], y[at]
        drawn.append(_correlations(_ranks(bx), _ranks(by)) if method == "spearman" else _correlations(bx, by))
    drawn = np.concatenate(drawn)
    drawn = drawn[np.isfinite(drawn)]
    low, high = np.quantile(drawn, [0.025, 0.975]) if len(drawn) else (np.nan, np.nan)
    return (hits + 1) / (permutations + 1), float(low), float(high)


def alignment(social: DataFrame, returns: DataFrame, seed: int = 1405) -> DataFrame:
    """The tests with coefficient, interval, permutation p-value and its Benjamini-Hochberg value within the test family; refused tests have none."""
    names = [*TEST, "method"]

    def draw(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.xs is None:
                    out.append((None, None, None))
                    continue
                own = crc32(repr([str(getattr(r, c)) for c in names]).encode())
                out.append(resampled(np.asarray(r.xs, float), np.asarray(r.ys, float), r.method, seed + own))
            p, low, high = zip(*out, strict=True) if out else ((), (), ())
            yield f.drop(columns=["xs", "ys"]).assign(p_value=pd.Series(p, f.index, dtype=float), ci_low=pd.Series(low, f.index, dtype=float), ci_high=pd.Series(high, f.index, dtype=float))

    tests = coefficients(social, returns)
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in tests.schema if x.name not in ("xs", "ys"))
    # A test is a row of thousands of draws, so tests are dealt one by one and not by bytes.
    drawn = tests.repartition(tests.sparkSession.sparkContext.defaultParallelism * 4, *names).mapInPandas(draw, f"{schema}, p_value double, ci_low double, ci_high double")
    clean = drawn.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("p_value", "ci_low", "ci_high")})
    done = F.col("p_value").isNotNull()
    held = clean.withColumn("test_id", F.concat_ws("|", *names)).withColumn("__family", F.when(done, F.col("test_family")))
    return benjamini_hochberg(held, "__family").withColumn("p_value_bh_fdr", F.when(done, F.col("q_value"))).drop("q_value", "__family", "test_id")
