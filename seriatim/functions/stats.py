"""Tail probabilities that the SQL engines lack, for small result tables on the driver or in UDFs."""

from __future__ import annotations

import math

#: The two critical values in use for 95 % intervals.
Z95, Z196 = 1.959963985, 1.96


def normal_p(z: float | None) -> float | None:
    """Two-sided P of a standard normal z."""
    return None if z is None or z != z else math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float | None, df: int) -> float | None:
    """Upper tail of a chi-square with a whole number of degrees of freedom.

    Closed forms: for even df a Poisson sum, for odd df erfc plus a finite series.
    """
    if x is None or x != x:
        return None
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def p_text(p: float) -> str:
    """P for a report; what underflows is shown as a bound."""
    return "<1e-300" if p <= 0 else f"{p:.3e}"


def adjusted_skew(population_skew: float, n: int) -> float:
    """The bias-adjusted sample skewness from the population one."""
    return population_skew * math.sqrt(n * (n - 1)) / (n - 2)
