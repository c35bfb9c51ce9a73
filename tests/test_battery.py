"""The battery against counts by hand, with groups that lack values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import battery, inference

SCHEMA = "content_id string, platform string, language_detected string, stance_label string, sentiment_label string, engagement_score double, text_raw string, annotation_status string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(k), ("x", "reddit", "youtube")[k % 3], "fa" if k % 2 else "en", ("support", "oppose", "unclear")[(k * k + k // 5) % 3], "positive" if k % 4 else "negative", float(k % 11) if k % 3 else None, None if k % 17 == 0 else "a" * (k % 13), "ok" if k % 10 else "api_failure") for k in range(120)]
    return rows, {r.comparison_id: r for r in battery.battery(spark.createDataFrame(rows, SCHEMA), ("x", "reddit", "youtube")).collect()}


def test_rows(found):
    rows, got = found
    assert len(got) == 2 + 3 * 3 + 1
    for b in ("reddit", "youtube"):
        r = got[f"mannwhitney_engagement_x_vs_{b}"]
        assert (r.status, r.n, r.n_group_a, r.p_value, r.effect_size, r.effect_size_ci_low) == ("not_applicable", 0, 0, None, None, None)
    a, b = ([r[5] for r in rows if r[1] == p and r[5] is not None] for p in ("reddit", "youtube"))
    r = got["mannwhitney_engagement_reddit_vs_youtube"]
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    assert (r.status, r.n, r.n_group_a) == ("ok", len(a) + len(b), len(a)) and r.estimate == np.median(a) - np.median(b)
    assert r.effect_size == pytest.approx(1 - 2 * u / (len(a) * len(b)), abs=1e-6) and r.effect_size_ci_low < r.effect_size < r.effect_size_ci_high
    a, b = (np.array([len(r[6] or "") for r in rows if r[1] == p], float) for p in ("x", "youtube"))
    r = got["welch_text_length_x_vs_youtube"]
    n, pooled = len(a) + len(b), np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    g = (a.mean() - b.mean()) / pooled * (1 - 3 / (4 * n - 9))
    se = (1 - 3 / (4 * n - 9)) * np.sqrt(n / (len(a) * len(b)) + g * g / (2 * (n - 2)))
    assert (r.effect_size, r.effect_size_ci_low, r.effect_size_ci_high) == pytest.approx((g, g - 1.959964 * se, g + 1.959964 * se), abs=1e-5)
    r = got["fisher_x_vs_reddit"]
    assert r.n_group_a == sum(r[1] == "x" and r[3] in ("support", "oppose") and r[7] == "ok" for r in rows)
    r = got["chi_square_stance_platform"]
    assert r.status == "ok" and r.n == sum(r[7] == "ok" for r in rows) and 0 <= r.effect_size_ci_low <= r.effect_size_ci_high <= 1


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert {r.status for r in battery.battery(df, ("x", "reddit")).collect()} == {"not_applicable"}
    one = spark.createDataFrame([("x", 1.0), ("reddit", 1.0)], "g string, v double")
    assert inference.welch(one, "g", "v", "x", "reddit").first().p_value is None
    assert inference.mann_whitney(one.filter(F.col("g") == "x"), "g", "v", "x", "reddit").first().p_value is None


def test_intervals_of_resampling():
    assert battery.bootstrap_v(np.zeros((2, 2))) is None and battery.bootstrap_r([], [1.0]) is None
    assert battery.bootstrap_v([[500, 0], [0, 500]]) == pytest.approx([1, 1]) and battery.bootstrap_r([3.0, 4.0], [1.0, 2.0]) == [-1, -1]
