"""Group comparisons: contingency tests, rank and mean tests, bootstrap.

Spark reduces the records to one row of counts or sums for each test; only the tail
probability of that row is a Python function. Without two groups it is null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.stats import chi2_tail, cramers_v, fisher_exact, normal_two_sided, t_two_sided


def _p(tail, *of: Column) -> Column:
    """The p-value of a test's one row, by its tail probability."""
    return F.round(F.udf(lambda *v: None if None in v else float(tail(*v)), "double")(*of), 6).alias("p_value")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, statistic, degrees of freedom, Cramer's V and p-value of the table of a by b (Yates' correction for 2 x 2)."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = F.broadcast(cells.agg(F.sum("o").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")))
    full = rows.crossJoin(F.broadcast(cols)).join(cells, ["a", "b"], "left").crossJoin(total)
    e = F.col("ra") * F.col("cb") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    plain = F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e
    s = full.agg(F.sum(F.pow(gap, 2) / e).alias("x"), F.sum(plain).alias("u"), F.max("n").alias("n"), F.max("r").alias("r"), F.max("c").alias("c"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    return s.select("n", F.round("x", 6).alias("chi2"), dof.alias("dof"), F.round(cramers_v(F.col("u"), F.col("n"), F.col("r"), F.col("c")), 6).alias("cramers_v"), _p(chi2_tail, F.col("x"), dof))


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """n, U, z with tie and continuity correction, its normal p-value, and rank-biserial r = 1 - 2 U / (n1 n2) (negative where ``a`` ranks higher).

    Ranks come from counts by value, so ties cost nothing and no row is sorted alone.
    """
    two = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    per = two.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"), F.count_if(F.col(group) == a).alias("ka"))
    below = F.coalesce(F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = per.withColumn("rank", below + (F.col("k") + 1) / 2).agg(F.sum(F.col("rank") * F.col("ka")).alias("ra"), F.sum("ka").alias("n1"), (F.sum("k") - F.sum("ka")).alias("n2"), F.sum(F.pow("k", 3) - F.col("k")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("ra") - F.col("n1") * (F.col("n1") + 1) / 2
    mid = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.abs(u - mid) - 0.5, sd)
    return s.select("n1", "n2", F.round(u, 6).alias("u"), F.round(z, 6).alias("z"), F.round(1 - F.try_divide(2 * u, F.col("n1") * F.col("n2")), 6).alias("rank_biserial"), _p(normal_two_sided, F.when(z.isNotNull(), F.greatest(z, F.lit(0.0)))))


def welch(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t with its degrees of freedom and p-value, Hedges' g and the 95 % interval of the difference's normal approximation."""
    in_a, in_b = F.col(group) == a, F.col(group) == b
    aggs = [f(F.when(c, F.col(value))).alias(f"{name}{side}") for side, c in (("1", in_a), ("2", in_b)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    s = df.agg(*aggs)
    c = F.col
    se2 = F.try_divide(c("v1"), c("n1")) + F.try_divide(c("v2"), c("n2"))
    parts = [F.try_divide(F.pow(F.try_divide(c(f"v{k}"), c(f"n{k}")), 2), c(f"n{k}") - 1) for k in (1, 2)]
    dof = F.try_divide(F.pow(se2, 2), parts[0] + parts[1])
    pooled = F.sqrt(F.try_divide((c("n1") - 1) * c("v1") + (c("n2") - 1) * c("v2"), c("n1") + c("n2") - 2))
    d = c("m1") - c("m2")
    g = F.try_divide(d, pooled) * (1 - F.try_divide(F.lit(3.0), 4 * (c("n1") + c("n2")) - 9))
    return s.select("n1", "n2", F.round(d, 6).alias("difference"), F.round(F.try_divide(d, F.sqrt(se2)), 6).alias("t"), F.round(dof, 4).alias("dof"), F.round(g, 6).alias("hedges_g"), F.round(d - 1.959963984540054 * F.sqrt(se2), 6).alias("ci_low"), F.round(d + 1.959963984540054 * F.sqrt(se2), 6).alias("ci_high"), _p(t_two_sided, F.try_divide(d, F.sqrt(se2)), dof))


def fisher(df: DataFrame, group: str, hit: str, a: str, b: str) -> DataFrame:
    """The 2 x 2 table of two groups by a flag, its odds ratio with the interval of the log odds (0.5 added to empty cells), and Fisher's exact p-value."""
    x = df.filter(F.col(group).isin(a, b)).agg(*[F.count_if((F.col(group) == g) & (F.coalesce(F.col(hit), F.lit(False)) == v)).alias(n) for n, g, v in (("a", a, True), ("b", a, False), ("c", b, True), ("d", b, False))])
    zero = (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)
    p = {n: F.col(n) + F.when(zero, 0.5).otherwise(0.0) for n in "abcd"}
    lo = F.ln(p["a"] * p["d"] / (p["b"] * p["c"]))
    se = 1.959963984540054 * F.sqrt(1 / p["a"] + 1 / p["b"] + 1 / p["c"] + 1 / p["d"])
    return x.select("a", "b", "c", "d", F.round(F.exp(lo), 6).alias("odds_ratio"), F.round(F.exp(lo - se), 6).alias("or_low"), F.round(F.exp(lo + se), 6).alias("or_high"), _p(fisher_exact, *(F.col(n) for n in "abcd")))


def bootstrap_share(df: DataFrame, hit: str, by: str, n_boot: int = 1000, seed: int = 1405) -> DataFrame:
    """Percentile interval of a share by group: resampling n rows of k hits is one binomial draw from the counts."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k = int(pdf["n"].iloc[0]), int(pdf["k"].iloc[0])
        shares = np.random.default_rng(seed).binomial(n, k / n, n_boot) / n
        low, high = np.percentile(shares, [2.5, 97.5])
        return pdf.assign(share=k / n, ci_low=low, ci_high=high)

    return counts.groupBy(by).applyInPandas(draw, f"{by} string, n long, k long, share double, ci_low double, ci_high double")


def pooled_log_odds(a: int, b: int, c: int, d: int) -> float:
    return math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
