"""Closed-form statistics as column expressions, and tail probabilities in numpy.

Undefined results are null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles by confidence (fixed values).
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def correlation(x: str, y: str) -> Column:
    """Pearson's r over the rows that have both; null without rows or where a side is constant, which Spark's own fails on."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _wilson(k: Column, n: Column, confidence: float, sign: int) -> Column:
    z = Z[confidence]
    p = k / n
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) + sign * margin) / (1 + z * z / n)


def wilson_low(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """Lower end of the Wilson interval of k in n; null where n is 0 or k is not within 0..n."""
    return F.when((n > 0) & (k >= 0) & (k <= n), F.greatest(F.lit(0.0), _wilson(k, F.nullif(n, F.lit(0)), confidence, -1)))


def wilson_high(k: Column, n: Column, confidence: float = 0.95) -> Column:
    return F.when((n > 0) & (k >= 0) & (k <= n), F.least(F.lit(1.0), _wilson(k, F.nullif(n, F.lit(0)), confidence, 1)))


def wilson_sql(k: str, n: str, sign: str, z: float = Z[0.95]) -> str:
    """The interval's end in SQL, rounded to 4 places: ``sign`` is - or +."""
    p = f"(({k}) * 1.0e0 / nullif({n}, 0))"
    body = f"({p} + {z * z!r} / (2 * ({n})) {sign} {z!r} * sqrt({p} * (1 - {p}) / ({n}) + {z * z!r} / (4 * ({n}) * ({n})))) / (1 + {z * z!r} / ({n}))"
    bound = f"greatest(0.0e0, {body})" if sign == "-" else f"least(1.0e0, {body})"
    return f"CASE WHEN ({n}) > 0 THEN round({bound}, 4) END"


def share(k: Column, n: Column, digits: int = 4) -> Column:
    """k / n rounded, null where n is 0."""
    return F.round(F.try_divide(k.cast("double"), n), digits)


def difference(k_a: Column, n_a: Column, k_b: Column, n_b: Column, confidence: float = 0.95) -> dict[str, Column]:
    """p_before, p_after, share_diff and the normal interval of p_b - p_a; all null where either n is 0."""
    known = (n_a > 0) & (n_b > 0)
    p_a, p_b = F.try_divide(k_a.cast("double"), n_a), F.try_divide(k_b.cast("double"), n_b)
    se = F.sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b)
    z, d = Z[confidence], p_b - p_a
    return {"p_before": F.when(known, p_a), "p_after": F.when(known, p_b), "share_diff": F.when(known, d), "ci_low": F.when(known, d - z * se), "ci_high": F.when(known, d + z * se)}


def cramers_v(chi2: Column, n: Column, rows: Column, cols: Column) -> Column:
    least = F.least(rows - 1, cols - 1)
    return F.when((n > 0) & (least > 0), F.sqrt(chi2 / n / least))


def naive_r(t: float, n: Column) -> Column:
    """The correlation that a t quantile corresponds to at n pairs."""
    return F.when(n > 2, t / F.sqrt(t * t + n - 2))


# Tail probabilities, for the few numbers that a test ends in.


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x)."""
    return gamma_upper(dof / 2, x / 2)


def beta_regular(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regular(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or tiny)
            c = 1 + an / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_regular(dof / 2, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2x2 table: tables as likely as the observed one or less."""
    rows, cols, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return sum(math.lgamma(v + 1) for v in (rows, n - rows, cols, n - cols)) - sum(math.lgamma(v + 1) for v in (n, x, rows - x, cols - x, n - rows - cols + x))

    seen = log_p(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, rows + cols - n), min(rows, cols) + 1) if (p := log_p(x)) <= seen + 1e-7))
