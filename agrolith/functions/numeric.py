"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, places: int = 4) -> Column:
    """Round the scaled double half to even, as numpy/pandas do.

    ``round`` in Spark is half-up and ``bround`` works on the decimal value;
    both differ from ``rint(x * 10^n) / 10^n`` on ties such as 0.00015.
    """
    scale = float(10 ** places)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def percent(part, whole, places: int = 2) -> Column:
    """100 * part / whole rounded; null when whole is 0 (ANSI-safe)."""
    return round_half_even(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")) * F.lit(100.0), places)


def clip_low(c, low: float = 0.0) -> Column:
    """Clip from below."""
    return F.greatest(_c(c), F.lit(float(low)))


def softmax(arr) -> Column:
    """Softmax over an array column, shifted by the max for stability."""
    a = _c(arr)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def fixed_logits(vector, classes: int) -> Column:
    """Logits of a fixed linear head over every entry of a vector column.

    The weight of entry i (from 1) for class j (from 0) is ((i (j + 1)) mod 7 - 3) / 8,
    a binary fraction, so a second engine gets the same sums.
    """
    def logit(j: int) -> Column:
        terms = F.transform(_c(vector), lambda x, i: x.cast("double") * (F.pmod((i + 1) * (j + 1), F.lit(7)) - 3) / 8.0)
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.array(*[logit(j) for j in range(classes)])


def fixed_logits_sql(vector: str, classes: int) -> str:
    """DuckDB twin of :func:`fixed_logits`."""
    return (f"list_transform(range(0, {classes}), lambda j: list_sum(list_transform(range(1, len({vector}) + 1), "
            f"lambda i: CAST({vector}[i] AS DOUBLE) * ((i * (j + 1)) % 7 - 3) / 8.0)))")


def argmax(arr) -> Column:
    """0-based index of the first largest element."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")
