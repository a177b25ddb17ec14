"""Tail probabilities for test statistics, as Arrow functions over aggregated rows (H).

The inputs are one row per group; the observations never reach Python.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample sizes (for the rank sum of the smaller sample) up to which untied samples use the exact distribution.
EXACT_SIGNED_RANK = 50
EXACT_RANK_SUM = 8


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@lru_cache(maxsize=256)
def signed_rank_counts(n: int) -> tuple[float, ...]:
    """Share of sign patterns of 1..n with each rank sum."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1.0
    for r in range(1, n + 1):
        c[r:] = c[r:] + c[:-r]
    return tuple(c / 2.0**n)


def rank_sum_tail(n1: int, n2: int, top: int) -> float:
    """Share of arrangements of two untied samples with U of at least ``top``.

    U is symmetric, so this is the share with U up to ``n1 * n2 - top``. The counts are the coefficients of the Gaussian
    binomial, a product of (1 - q^(n2 + i)) over (1 - q^i) for i up to the smaller size: one shifted difference and one strided
    running sum each, on only as many coefficients as the tail has.
    """
    n1, n2 = sorted((n1, n2))
    last = n1 * n2 - top
    if last < 0:
        return 0.0
    if last >= n1 * n2:
        return 1.0
    c = np.zeros(last + 1, dtype=np.longdouble)
    c[0] = 1.0
    for i in range(1, n1 + 1):
        shift = n2 + i
        if shift <= last:
            c[shift:] = c[shift:] - c[: last + 1 - shift]
        rows = -(-(last + 1) // i)
        padded = np.zeros(rows * i, dtype=np.longdouble)
        padded[: last + 1] = c
        c = np.cumsum(padded.reshape(rows, i), axis=0).reshape(-1)[: last + 1]
    return float(c.sum() / np.longdouble(math.comb(n1 + n2, n1)))


def signed_rank_p(r_plus: float, n: float, ties: float, has_zero: bool, alternative: str) -> float | None:
    """p-value of the signed-rank test: exact for small untied samples, else normal without continuity correction."""
    if r_plus is None or n is None or n != n or n < 1:
        return None
    n = int(n)
    if n <= EXACT_SIGNED_RANK and ties == 0 and not has_zero:
        c = np.array(signed_rank_counts(n))
        r = int(round(r_plus))
        below, above = float(c[: r + 1].sum()), float(c[r:].sum())
        return {"two-sided": min(1.0, 2 * min(below, above)), "greater": above, "less": below}[alternative]
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0)
    if se == 0:
        return None
    z = (r_plus - n * (n + 1) / 4.0) / se
    return {"two-sided": 2 * normal_sf(abs(z)), "greater": normal_sf(z), "less": normal_sf(-z)}[alternative]


def rank_sum_p(u: float, n1: float, n2: float, ties: float) -> float | None:
    """Two-sided p of the rank-sum test: exact for small untied samples, else tie and continuity corrected."""
    if u is None or not n1 or not n2:
        return None
    n1, n2 = int(n1), int(n2)
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= EXACT_RANK_SUM and ties == 0:
        return min(1.0, 2 * rank_sum_tail(n1, n2, int(round(top))))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, 2 * normal_sf((top - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)))


def chi_square_sf(x: float, df: float) -> float | None:
    """Upper tail of the chi-square distribution by the incomplete gamma function."""
    if x is None or df is None or x != x or df <= 0:
        return None
    if x <= 0:
        return 1.0
    a, h = df / 2.0, x / 2.0
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return 1.0 - total * scale
    b = h + 1 - a
    c, d = 1e300, 1.0 / b
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        f *= step
        if abs(step - 1) < 1e-16:
            break
    return f * scale


def _each(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype(object).where(s.notna(), None) for s in series])
    return pd.Series([None if r[0] is None else fn(*r) for r in rows], dtype="float64")


def signed_rank_p_col(r_plus: Column, n: Column, ties: Column, has_zero: Column, alternative: str) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _each(lambda r, n_, t, z: signed_rank_p(r, n_, t, bool(z), alternative), a, b, c, d)

    return p(r_plus.cast("double"), n.cast("double"), ties.cast("double"), has_zero.cast("int"))


def rank_sum_p_col(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _each(rank_sum_p, a, b, c, d)

    return p(u.cast("double"), n1.cast("double"), n2.cast("double"), ties.cast("double"))


def chi_square_sf_col(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(chi_square_sf, a, b)

    return p(x.cast("double"), df.cast("double"))
