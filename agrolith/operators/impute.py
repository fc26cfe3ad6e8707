"""Missing-value filling.

Statistics for all columns come from one aggregate (or one quantile run over
the unpivoted columns) and are attached to the rows as a one-row table, so the
fill is a projection. Group statistics are joined back on the group key; the
join strategy is left to the planner, which broadcasts by bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.quantile import _ns_join, exact_medians_many
from agrolith.session import stage_table

STRATEGIES = ("mean", "median", "most_frequent", "constant")


def _stats_row(df: DataFrame, cols: Sequence[str], strategy: str, fill_value=None) -> DataFrame:
    """One row: column -> fill value, as ``_fill_<col>`` columns."""
    if strategy == "mean":
        return df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_fill_{c}") for c in cols])
    if strategy == "median":
        med = exact_medians_many(df, cols)
        return med.groupBy().pivot("measure", list(cols)).agg(F.first("median")) \
            .select(*[F.col(c).alias(f"_fill_{c}") for c in cols])
    if strategy == "most_frequent":
        modes = most_frequent(df, cols)
        return modes.groupBy().pivot("measure", list(cols)).agg(F.first("mode")) \
            .select(*[F.col(c).alias(f"_fill_{c}") for c in cols])
    if strategy == "constant":
        return df.sparkSession.range(1).select(*[F.lit(fill_value).alias(f"_fill_{c}") for c in cols])
    raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")


def most_frequent(df: DataFrame, cols: Sequence[str], as_string: bool = False) -> DataFrame:
    """Mode per column, ties to the smallest value: ``(measure, mode)``.

    Values are counted with a distributed group-by (partial counts per task),
    then the winner per column is a ``min_by`` over (-count, value), which also
    aggregates partially; no task ever holds all distinct values.
    """
    cast = "string" if as_string else "double"
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast(cast).alias("v")) for c in cols])
    long = df.select(F.explode(pairs).alias("kv")).select("kv.measure", "kv.v").where(F.col("v").isNotNull())
    counts = long.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("measure").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("mode"))


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", fill_value=None,
           categorical: bool = False) -> DataFrame:
    """Fill nulls of ``cols`` with a statistic of each column.

    Numeric columns become double (the reference's float result). A column with
    no value at all cannot be imputed and raises at run time (I3 contract).
    """
    cols = list(cols)
    if not cols:
        return df
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
    if categorical:
        if strategy not in ("most_frequent", "constant"):
            raise ValueError("categorical columns take most_frequent or constant")
        if strategy == "most_frequent":
            modes = most_frequent(df, cols, as_string=True)
            stats = modes.groupBy().pivot("measure", cols).agg(F.first("mode")) \
                .select(*[F.col(c).alias(f"_fill_{c}") for c in cols])
        else:
            stats = df.sparkSession.range(1).select(
                *[F.lit(fill_value if fill_value is not None else "missing_value").alias(f"_fill_{c}") for c in cols])
    else:
        stats = _stats_row(df, cols, strategy, 0.0 if fill_value is None else float(fill_value))
    out = df.crossJoin(stats)  # one-row statistics table
    for c in cols:
        fv = F.col(f"_fill_{c}")
        guard = F.when(fv.isNull() & F.col(c).isNull(),
                       F.raise_error(F.lit(f"column {c} has no value to impute from")))
        val = F.coalesce(F.col(c).cast("string" if categorical else "double"), guard.otherwise(fv))
        out = out.withColumn(c, val)
    return out.drop(*[f"_fill_{c}" for c in cols])


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls left per column, one row."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def group_median_fill(df: DataFrame, cols: Sequence[str], group_col: str) -> DataFrame:
    """Fill with the group median, then with the global median of the result.

    The fallback median is taken after the group fill (a group with no value
    at all gets the median of the filled column). Rows with a null group key
    keep their observed value. The group medians are computed while the plan is
    built (one row per group), the fallback with the rows. ``df`` is read several
    times: stage it first when it is costly to compute.
    """
    cols = list(cols)
    gm = exact_medians_many(df, cols, [group_col], staged=True)
    gwide = gm.groupBy(group_col).pivot("measure", cols).agg(F.first("median"))
    gwide = stage_table(gwide.select(group_col, *[F.col(c).alias(f"_gm_{c}") for c in cols]), "group-medians")  # a row per group
    out = _ns_join(df, gwide, [group_col], "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_gm_{c}")))
    out = out.drop(*[f"_gm_{c}" for c in cols])
    glob = exact_medians_many(out, cols)
    gw = glob.groupBy().pivot("measure", cols).agg(F.first("median")) \
        .select(*[F.col(c).alias(f"_fb_{c}") for c in cols])
    out = out.crossJoin(gw)  # one-row fallback table
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_fb_{c}")))
    return out.drop(*[f"_fb_{c}" for c in cols])


__all__ = ["STRATEGIES", "group_median_fill", "impute", "most_frequent", "null_counts"]
