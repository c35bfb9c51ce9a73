"""Alignment against a brute-force count of pairs, ranks and permutations."""

import math
from itertools import permutations

import numpy as np
import pytest

from weirflow.operators import alignment

WEEKS = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]


def mean_ranks(v):
    return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


@pytest.fixture(scope="module")
def inputs(spark):
    social = [("x", "o", "t", 15 + k, float(v)) for k, v in enumerate(WEEKS)] + [("x", "flat", None, 15 + k, 1.0) for k in range(12)] + [("x", "o", "t", 99, None)]
    returns = [(15 + k, "a", "main", float((k * 7) % 5)) for k in range(14)] + [(15 + k, "s", "sensitivity", float((k * 3) % 7)) for k in range(9)] + [(16, "n", "unused", 1.0)]
    return spark.createDataFrame(social, "platform string, outcome_id string, target_id string, week int, outcome_value double"), spark.createDataFrame(returns, "week int, asset_id string, analysis_use string, value double")


def brute(inputs):
    social, returns = ([tuple(r) for r in df.collect()] for df in inputs)
    out = {}
    for key in {r[:3] for r in social}:
        for variant, use, methods, without in alignment.VARIANTS:
            for asset in {r[1] for r in returns if r[2] == use}:
                for lag in alignment.LAGS:
                    pairs = [(v, y) for *k, w, v in social for fw, a, u, y in returns if tuple(k) == key and a == asset and u == use and fw - lag == w and v is not None and without not in (w, fw)]
                    x, y = [p[0] for p in pairs], [p[1] for p in pairs]
                    for method in methods:
                        able = len(pairs) >= 10 and len(set(x)) > 1 and len(set(y)) > 1
                        r = (pearson(x, y) if method == "pearson" else pearson(mean_ranks(x), mean_ranks(y))) if able else None
                        out[*key, variant, asset, lag, method] = (len(pairs), r)
    return out


def test_coefficients(inputs):
    want = brute(inputs)
    got = {(r.platform, r.outcome_id, r.target_id, r.analysis_variant, r.asset_id, r.financial_lag_weeks, r.method): r for r in alignment.coefficients(*inputs).collect()}
    assert got.keys() == want.keys() and any(r is not None for _, r in want.values())
    for key, (n, r) in want.items():
        assert got[key].n_paired_weeks == n and (got[key].coefficient is None) == (r is None)
        assert r is None or got[key].coefficient == pytest.approx(r, abs=1e-12)
        assert got[key].status == (alignment.REFUSED if r is None else alignment.DONE)


def test_drawn_values(inputs):
    rows = alignment.alignment(*inputs).collect()
    again = alignment.alignment(*inputs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    done = [r for r in rows if r.coefficient is not None]
    assert done and all(r.p_value is None and r.p_value_bh_fdr is None and r.ci_low is None for r in rows if r.coefficient is None)
    assert all(r.ci_low <= r.coefficient <= r.ci_high and 0 < r.p_value <= r.p_value_bh_fdr <= 1 for r in done)
    for family in {r.test_family for r in done}:
        ps = sorted((r.p_value, r.p_value_bh_fdr) for r in done if r.test_family == family)
        least = 1.0
        for k in range(len(ps), 0, -1):
            least = min(least, ps[k - 1][0] * len(ps) / k)
            assert ps[k - 1][1] == pytest.approx(least, abs=1e-6)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_permutation_share(method):
    x, y = np.array([1.0, 2, 2, 4, 7, 5, 9]), np.array([2.0, 1, 3, 3, 8, 4, 4])
    ranked = method == "spearman"
    a, b = (mean_ranks(x), mean_ranks(y)) if ranked else (list(x), list(y))
    seen = abs(pearson(a, b)) - 1e-12
    all_of = [abs(pearson(a, p)) >= seen for p in permutations(b)]
    p, low, high = alignment.resampled(x, y, method, 7)
    assert p == pytest.approx(sum(all_of) / len(all_of), abs=0.01) and -1 <= low < high <= 1


def test_empty_tables(inputs):
    social, returns = inputs
    assert alignment.alignment(social.limit(0), returns).count() == 0
    assert alignment.alignment(social, returns.limit(0)).count() == 0
