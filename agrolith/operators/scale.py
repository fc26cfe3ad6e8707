"""Feature scaling (C1-C3): min-max and standard (population std), with inverse.

Statistics come from one aggregate over all columns and stay a DataFrame (one
row, or one row per group when fitted per fold), attached to the rows by a
one-row cross join or a join on the group key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("minmax", "standard")


@dataclass
class Scaler:
    method: str
    cols: list[str]
    stats: DataFrame  # columns: by..., <c>__a, <c>__b  (offset, divisor)
    by: list[str] = field(default_factory=list)

    def _attach(self, df: DataFrame) -> DataFrame:
        if self.by:
            return df.join(self.stats, self.by, "left")
        return df.crossJoin(self.stats)  # one-row statistics

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._attach(df)
        out = out.withColumns({c: (F.col(c).cast("double") - F.col(f"{c}__a")) / F.col(f"{c}__b")
                               for c in self.cols})
        return out.drop(*[f"{c}__{s}" for c in self.cols for s in "ab"])

    def inverse(self, df: DataFrame) -> DataFrame:
        out = self._attach(df)
        out = out.withColumns({c: F.col(c) * F.col(f"{c}__b") + F.col(f"{c}__a") for c in self.cols})
        return out.drop(*[f"{c}__{s}" for c in self.cols for s in "ab"])


def fit(df: DataFrame, cols: Sequence[str], method: str = "standard", by: Sequence[str] = ()) -> Scaler:
    """Fit a scaler; an unknown method is an error.

    minmax: (x - min) / (max - min), a constant column maps to 0.
    standard: (x - mean) / std_pop, a zero std divides by 1.
    ``by`` fits one set of statistics per group (for per-fold scaling).
    """
    if method not in METHODS:
        raise ValueError(f"unknown scaler {method!r}; use one of {METHODS}")
    cols = list(cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if method == "minmax":
            lo, hi = F.min(x), F.max(x)
            aggs += [lo.alias(f"{c}__a"),
                     F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo).alias(f"{c}__b")]
        else:
            sd = F.stddev_pop(x)
            aggs += [F.avg(x).alias(f"{c}__a"),
                     F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__b")]
    stats = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return Scaler(method, cols, stats, list(by))


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> tuple[DataFrame, Scaler]:
    """Fit on ``df`` and transform it; returns the scaled table and the fitted scaler."""
    s = fit(df, cols, method)
    return s.transform(df), s
