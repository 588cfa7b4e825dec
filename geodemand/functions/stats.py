"""Distribution functions used by the panel fits; small numeric helpers inside tasks."""

from __future__ import annotations

import math

# Two-sided 90 % normal quantile.
Z90 = 1.645


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of chi-square for an even number of degrees of freedom (closed form)."""
    h, term, total = x / 2.0, 1.0, 0.0
    for i in range(df // 2):
        total += term
        term *= h / (i + 1)
    return math.exp(-h) * total
