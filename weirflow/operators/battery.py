"""The battery of group comparisons: one row a test, with its effect size, interval and p-value.

Each test reduces the records to counts or sums first. Intervals of Cramer's V and of the rank-biserial r are bootstrapped:
V from the table's counts, r from a bounded sample of each group, as the values of a group have no bound.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators import inference

# Draws, and values of a group that are drawn from at most (for its interval alone).
N_BOOT, MAX_BOOTSTRAP_N, SEED = 1000, 5000, 1405
COLUMNS = ["comparison_id", "test", "effect_size_type", "n", "n_group_a", "n_group_b", "estimate", "effect_size", "effect_size_ci_low", "effect_size_ci_high", "p_value", "status"]


def _ends(drawn: np.ndarray) -> list[float] | None:
    drawn = drawn[np.isfinite(drawn)]
    return [float(v) for v in np.percentile(drawn, [2.5, 97.5])] if len(drawn) else None


def bootstrap_v(table, draws: int = N_BOOT, seed: int = SEED) -> list[float] | None:
    """95 % interval of Cramer's V: resampling the records of a table is a multinomial draw of its cells."""
    table = np.asarray(table, float)
    if not table.sum():
        return None
    t = np.random.default_rng(seed).multinomial(int(table.sum()), table.ravel() / table.sum(), draws).reshape(draws, *table.shape).astype(float)
    rows, cols, n = t.sum(2, keepdims=True), t.sum(1, keepdims=True), t.sum((1, 2))
    e = rows * cols / n[:, None, None]
    chi = np.divide((t - e) ** 2, e, out=np.zeros_like(t), where=e > 0).sum((1, 2))
    least = np.minimum((rows > 0).sum((1, 2)), (cols > 0).sum((1, 2))) - 1
    return _ends(np.sqrt(np.divide(chi, n * least, out=np.full(draws, np.nan), where=least > 0)))


def bootstrap_r(a, b, draws: int = N_BOOT, seed: int = SEED) -> list[float] | None:
    """95 % interval of the rank-biserial r, 1 - 2 U / (n1 n2), over resampled groups."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a) or not len(b):
        return None
    rng, out = np.random.default_rng(seed), np.empty(draws)
    for k in range(draws):
        x, y = rng.choice(a, len(a)), np.sort(rng.choice(b, len(b)))
        u = (np.searchsorted(y, x, "left") + np.searchsorted(y, x, "right")).sum() / 2
        out[k] = 1 - 2 * u / (len(a) * len(b))
    return _ends(out)


def _row(df: DataFrame, name: str, test: str, kind: str, status: Column, **values: Column) -> DataFrame:
    null = F.lit(None)
    made = {"comparison_id": F.lit(name), "test": F.lit(test), "effect_size_type": F.lit(kind), "status": status} | values
    types = {"n": "long", "n_group_a": "long", "n_group_b": "long"} | {c: "double" for c in COLUMNS[6:11]}
    return df.select(*[(made.get(c, null).cast(types[c]) if c in types else made[c]).alias(c) for c in COLUMNS])


def _interval(ends: Column) -> dict[str, Column]:
    return {"effect_size_ci_low": F.round(F.get(ends, 0), 6), "effect_size_ci_high": F.round(F.get(ends, 1), 6)}


def _done(able: Column) -> Column:
    return F.when(F.coalesce(able, F.lit(False)), "ok").otherwise("not_applicable")


def chi_row(df: DataFrame, group: str, label: str, name: str) -> DataFrame:
    cells = df.filter(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).alias("a"), F.col(label).alias("b")).agg(F.count("*").alias("o"))

    def ends(rows):
        a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
        table = np.zeros((len(a), len(b)))
        for r in rows:
            table[a.index(r.a), b.index(r.b)] = r.o
        return bootstrap_v(table) if rows else None

    # A table has a cell for each pair of labels, so its cells are one short list.
    of = cells.agg(F.udf(ends, "array<double>")(F.array_sort(F.collect_list(F.struct("a", "b", "o")))).alias("ends"))
    s = inference.chi_square(df, group, label).crossJoin(of)
    return _row(s, name, "chi_square", "cramers_v", _done(F.col("p_value").isNotNull()), n=F.coalesce("n", F.lit(0)), estimate=F.col("chi2"), effect_size=F.col("cramers_v"), p_value=F.col("p_value"), **_interval(F.col("ends")))


def fisher_row(df: DataFrame, group: str, label: str, yes: str, no: str, a: str, b: str) -> DataFrame:
    """The table of two groups by two labels; records of other labels do not count."""
    two = df.filter(F.col(label).isin(yes, no)).withColumn("__hit", F.col(label) == yes)
    s = inference.fisher(two, group, "__hit", a, b)
    first, second = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    able = (first > 0) & (second > 0)
    return _row(s, f"fisher_{a}_vs_{b}", "fisher_exact", "odds_ratio", _done(able), n=first + second, n_group_a=first, n_group_b=second, estimate=F.when(able, F.col("odds_ratio")), effect_size=F.when(able, F.col("odds_ratio")), effect_size_ci_low=F.when(able, F.col("or_low")), effect_size_ci_high=F.when(able, F.col("or_high")), p_value=F.when(able, F.col("p_value")))


def mann_whitney_row(df: DataFrame, group: str, value: str, a: str, b: str, key: str, name: str) -> DataFrame:
    """Without values in one of the groups the row says so, with n = 0."""
    def some(g: str) -> DataFrame:
        rows = df.filter((F.col(group) == g) & F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h"))
        return rows.orderBy("h", "v").limit(MAX_BOOTSTRAP_N).agg(F.array_sort(F.collect_list("v")).alias(f"some_{'a' if g == a else 'b'}"))

    of = some(a).crossJoin(some(b)).select(F.udf(bootstrap_r, "array<double>")("some_a", "some_b").alias("ends"))
    medians = df.agg(*[F.percentile(F.when(F.col(group) == g, F.col(value)), F.lit(0.5)).alias(n) for g, n in ((a, "ma"), (b, "mb"))])
    s = inference.mann_whitney(df, group, value, a, b).crossJoin(of).crossJoin(medians)
    able = F.coalesce((F.col("n1") > 0) & (F.col("n2") > 0), F.lit(False))
    only = lambda c: F.when(able, c)
    return _row(s, name, "mann_whitney_u", "rank_biserial_r", _done(able), **{c: F.when(able, v).otherwise(0) for c, v in (("n", F.col("n1") + F.col("n2")), ("n_group_a", F.col("n1")), ("n_group_b", F.col("n2")))}, estimate=only(F.round(F.col("ma") - F.col("mb"), 6)), effect_size=only(F.col("rank_biserial")), p_value=only(F.col("p_value")), **_interval(only(F.col("ends"))))


def welch_row(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    s = inference.welch(df, group, value, a, b)
    n, g = F.col("n1") + F.col("n2"), F.col("hedges_g")
    se = (1 - F.try_divide(F.lit(3.0), 4 * n - 9)) * F.sqrt(F.try_divide(n, F.col("n1") * F.col("n2")) + F.try_divide(g * g, 2.0 * (n - 2)))
    ends = F.array(g - 1.959963984540054 * se, g + 1.959963984540054 * se)
    return _row(s, f"welch_{value}_{a}_vs_{b}", "welch_t_test", "hedges_g", _done(F.col("p_value").isNotNull()), n=n, n_group_a=F.col("n1"), n_group_b=F.col("n2"), estimate=F.col("difference"), effect_size=g, p_value=F.col("p_value"), **_interval(ends))


def battery(records: DataFrame, platforms, key: str = "content_id") -> DataFrame:
    """Stance by platform and by language; of each two platforms support against oppose, engagement and text length; and
    engagement of positive against negative records of the last platform. Labels count where the annotation is ok."""
    df = records.withColumn("text_length", F.char_length(F.coalesce("text_raw", F.lit(""))))
    ok = df.filter("annotation_status = 'ok'")
    rows = [chi_row(ok, "platform", "stance_label", "chi_square_stance_platform"), chi_row(ok, "language_detected", "stance_label", "chi_square_stance_language")]
    for a, b in combinations(platforms, 2):
        rows.append(fisher_row(ok, "platform", "stance_label", "support", "oppose", a, b))
        rows.append(mann_whitney_row(df, "platform", "engagement_score", a, b, key, f"mannwhitney_engagement_{a}_vs_{b}"))
        rows.append(welch_row(df, "platform", "text_length", a, b))
    last = platforms[-1]
    own = mann_whitney_row(ok.filter(F.col("platform") == last), "sentiment_label", "engagement_score", "positive", "negative", key, f"mannwhitney_engagement_{last}_positive_vs_negative")
    rows.append(own.filter("status = 'ok'"))
    return reduce(DataFrame.unionByName, rows)
