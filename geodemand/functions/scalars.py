"""Null-safe column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value to [lo, hi]; null stays null (greatest/least alone would fill it)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    return F.when(c.isNotNull(), out)


def guarded_ratio(num, den, eps: float = 1e-9, default: float | None = 0.0) -> Column:
    """num/den where den exceeds eps, else the default."""
    return F.when(col(den) > eps, col(num) / col(den)).otherwise(F.lit(default).cast("double"))


def floored_ratio(num, den, eps: float = 1e-9) -> Column:
    """num over den with the denominator never below eps."""
    return col(num) / F.greatest(col(den), F.lit(eps))


def right_closed_bin(c: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edges[i], edges[i+1]] that holds the value, null outside all."""
    c = col(c)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(out)
    return out


def coefficient(c: str | Column, table: dict, default: float) -> Column:
    """Coefficient a small fixed mapping gives for a value, else the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col(c)].cast("double"), F.lit(float(default)))


def dot(columns: list, weights: list) -> Column:
    """Weighted sum across the columns of one row."""
    return reduce(lambda a, b: a + b, [col(c) * F.lit(float(w)) for c, w in zip(columns, weights)])


def dominant(columns: list[str], names: list[str] | None = None) -> Column:
    """Name of the largest column of a row; the earliest column wins a tie."""
    names = names or columns
    cells = [
        F.struct(F.col(c).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
        for i, (c, n) in enumerate(zip(columns, names))
    ]
    return F.array_max(F.array(*cells))["n"]


def largest_departures(columns: list[str], n: int) -> Column:
    """Array of (absolute value, column index, value), largest first, n entries."""
    cells = [
        F.struct((-F.abs(F.col(c))).alias("k"), F.lit(i).alias("i"), F.col(c).alias("v"))
        for i, c in enumerate(columns)
    ]
    return F.slice(F.array_sort(F.array(*cells)), 1, n)


def finite_or_null(c: str | Column) -> Column:
    """NaN and infinities become null; JSON has no way to write them."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def letters_and_digits(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^\\p{L}\\p{N}]", "")


def slug(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(col(c), "[^\\p{L}\\p{N}]", "_"))


def amount_text(c: str | Column, unit: str = "", money: bool = False, symbol: str = "₹") -> Column:
    """Tiered number text: crores, whole thousands, or one decimal."""
    c = col(c)
    a = F.abs(c)
    plain = F.when(a >= 100, F.format_number(c, 0)).otherwise(F.format_number(c, 1))
    small = F.concat(F.lit(symbol), F.format_number(c, 0)) if money else F.concat(plain, F.lit(unit))
    return (
        F.when(c.isNull(), F.lit("n/a"))
        .when(a >= 1e7, F.concat(F.lit(symbol), F.format_number(c / 1e7, 0), F.lit(" cr")))
        .otherwise(small)
    )


def signed_text(c: str | Column, digits: int) -> Column:
    """Number with an explicit sign, e.g. +1.3."""
    return F.format_string(f"%+.{digits}f", col(c))


def all_of(conditions: list) -> Column:
    """AND of the given conditions; true where there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals_all(filters: dict) -> Column:
    """AND of equality filters, leaving out the ones that are not set."""
    return all_of([F.col(k) == v for k, v in filters.items() if v is not None])


# Far above the noise of a double sum of ordinary size, far below any digit that is kept.
NUDGE = 3e-11


def steady_round(c: str | Column, digits: int) -> Column:
    """Rounding in which values that sit on an exact half always go the same way.

    Sums taken in another order differ in the last bit; without the nudge that bit would decide
    which way a half is rounded and a rebuild could differ from the first build.
    """
    return F.round(col(c) + NUDGE, digits)
