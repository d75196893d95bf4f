"""Tail probabilities of rank tests: exact null distributions for small samples, closed forms beyond.

Plain functions of a few numbers, called through pandas UDFs on tables with one row a test.
"""

from __future__ import annotations

from math import comb, erfc, exp, lgamma, log, pi, sqrt

import numpy as np


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


#: Null distributions made so far; a task makes each once. (A plain dictionary travels with the functions.)
_known: dict[tuple[int, ...], tuple[int, ...]] = {}


def u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """Arrangements by U: the coefficients of the Gaussian binomial of n1 + n2 over n1."""
    if (n1, n2) in _known:
        return _known[n1, n2]
    size = n1 * n2 + 1
    c = [0] * size
    c[0] = 1
    for i in range(1, n1 + 1):
        for k in range(size - 1, n2 + i - 1, -1):  # times 1 - q^(n2 + i)
            c[k] -= c[k - n2 - i]
        for k in range(i, size):  # over 1 - q^i
            c[k] += c[k - i]
    _known[n1, n2] = tuple(c)
    return _known[n1, n2]


def mann_whitney_p(n1: int, n2: int, u: float, ties: float, exact_up_to: int = 8) -> float:
    """Two-sided. Exact if the smaller sample has at most ``exact_up_to`` values and no values tie; else normal with
    tie-corrected variance and continuity correction. ties: sum of t^3 - t."""
    big = max(u, n1 * n2 - u)
    if min(n1, n2) <= exact_up_to and ties == 0:
        lo, hi = sorted((n1, n2))
        tail = sum(u_counts(lo, hi)[round(big) :])
        return min(1.0, 2 * tail / comb(n1 + n2, n1))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, erfc((big - n1 * n2 / 2 - 0.5) / sqrt(var) / sqrt(2)))


def signed_rank_counts(n: int) -> tuple[int, ...]:
    """Sign patterns of the ranks 1 to n by the sum of the positive ones."""
    if (n,) in _known:
        return _known[n,]
    c = [1]
    for r in range(1, n + 1):
        d = c + [0] * r
        for k, x in enumerate(c):
            d[k + r] += x
        c = d
    _known[n,] = tuple(c)
    return _known[n,]


def wilcoxon_p(n: int, w_plus: float, ties: float, zeros: int, exact_up_to: int = 50) -> float | None:
    """Two-sided signed-rank test of n non-zero differences. Exact up to ``exact_up_to`` without zeros and ties, else
    normal without continuity correction; None without a difference."""
    if n < 1:
        return None
    if n <= exact_up_to and zeros == 0 and ties == 0:
        c, k = signed_rank_counts(n), round(w_plus)
        return min(1.0, 2 * min(sum(c[: k + 1]), sum(c[k:])) / 2**n)
    var = (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    return normal_two_sided((w_plus - n * (n + 1) / 4) / sqrt(var)) if var > 0 else 1.0


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x): a finite sum, started by erfc for odd df."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return exp(-x / 2) * total
    total, term = erfc(sqrt(x / 2)), sqrt(2 * x / pi) * exp(-x / 2)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return total


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables of the same margins that are no more likely than this one."""
    n, r, k = a + b + c + d, a + b, a + c
    lo, hi = max(0, r + k - n), min(r, k)
    logs = np.array([_log_comb(r, x) + _log_comb(n - r, k - x) for x in range(lo, hi + 1)]) - _log_comb(n, k)
    p = np.exp(logs)
    return float(min(1.0, p[p <= p[a - lo] * (1 + 1e-7)].sum()))


def _log_comb(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def t_two_sided(t: float, df: int) -> float:
    """Two-sided tail of Student's t by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    return _betainc(df / 2, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    f, c, d = 1.0, 1.0, 0.0
    for m in range(0, 300):
        for even in (True, False):
            if m == 0 and even:
                num = 1.0
            elif even:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) / a


def correlation_p(r: float, n: int) -> float | None:
    if n < 3 or r is None:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * sqrt((n - 2) / (1 - r * r)), n - 2)
