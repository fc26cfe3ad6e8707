"""Exact quantiles per group (A3, A4, A6, A18) in two passes, without putting a group in one task.

Spark's exact ``percentile``/``median`` keeps a map of every distinct value of a
group in the task that finishes the group; a group holding a third of a 100 TB
table would not fit. Here, for all groups and probabilities at once:

1. one pass builds a mergeable quantile summary per group (``percentile_approx``:
   partial per task, of bounded size). A wanted rank lies at most ``1/accuracy``
   of the rows from what the summary says, so the summary's values at four times
   that distance on both sides bracket it; small groups are their own bracket;
2. the other pass counts, per group and probability, the rows below the bracket
   and every value inside it (partial counts; what lies above is dropped at
   once). The counts are cut into ``SLICES`` even slices of the bracket, ordered
   inside a slice, and offset by the slices before, so a rank is found exactly
   without ordering a bracket in one task;
3. the two ranks ``floor((n-1)p)+1`` and ``ceil((n-1)p)+1`` are interpolated as
   ``lo + (hi - lo) * frac`` (the linear rule of pandas and of SQL
   ``quantile_cont``). A rank outside its bracket is an error, never a guess.

Nothing runs while the plan is built, unless ``staged``: both passes belong to
the action that reads the quantiles. The second pass must not be dealt out by the
group, or a group is in one task again. The planner does not know how few the
brackets are; so they are one row without groups, broadcast where the groups are
names of columns, and ``staged`` (written once, a row per group, so that their
bytes are known and the planner broadcasts them) where they come from the data.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.session import stage_table

_X = "_qx"
_MAX = sys.float_info.max
ACCURACY = 10_000
SLICES = 64


def _ns_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys``; the right copies are dropped."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), accuracy: int = ACCURACY, staged: bool = False, few: bool = False) -> DataFrame:
    """Long form: ``group_cols + [prob_id, prob, value]``; groups with no value absent. ``df`` is read twice.

    ``few``: the groups are bounded by the plan (such as names of columns), not by the data.
    ``staged``: the first pass runs now.
    """
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    data = df.select(*g, x.alias(_X)).where(F.col(_X).isNotNull() & ~F.isnan(F.col(_X)))
    wide = 4.0 / accuracy
    ends = [min(1.0, max(0.0, p + s * wide)) for p in probs for s in (-1, 1)]
    stats = data.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min(_X).alias("lo"), F.max(_X).alias("hi"),
                                 F.percentile_approx(_X, ends, accuracy).alias("ends"))
    small = F.col("n") <= accuracy
    wanted = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1).cast("double") * F.lit(float(p))
        wanted.append(F.struct(F.lit(i).alias("prob_id"), F.lit(float(p)).alias("prob"),
                               F.when(small | F.lit(ends[2 * i] <= 0), F.col("lo")).otherwise(F.col("ends")[2 * i]).alias("low"),
                               F.when(small | F.lit(ends[2 * i + 1] >= 1), F.col("hi")).otherwise(F.col("ends")[2 * i + 1]).alias("high"),
                               (F.floor(pos) + 1).cast("long").alias("klo"), (F.ceil(pos) + 1).cast("long").alias("khi"),
                               (pos - F.floor(pos)).alias("frac")))
    brackets = stats.select(*g, F.array(*wanted).alias("want"))
    if few:
        brackets = F.broadcast(brackets)
    elif staged:
        brackets = stage_table(brackets, "brackets")

    # per probability: rows below the bracket (no value) and the values inside it
    met = _ns_join(data, brackets, g)
    part = []
    for i in range(len(probs)):
        w, v = F.col("want")[i], F.col(_X)
        part.append(F.when(v <= w["high"], F.struct(
            F.lit(i).alias("prob_id"), F.when(v >= w["low"], v).alias("v"),
            F.when(v >= w["low"], _slice(v, w["low"], w["high"])).otherwise(-1).alias("slice"))))
    counts = met.select(*g, F.explode(F.array(*part)).alias("c")).where(F.col("c").isNotNull()) \
        .groupBy(*g, "c.prob_id", "c.slice", "c.v").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*g, "prob_id", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*g, "prob_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.groupBy(*g, "prob_id", "slice").agg(F.sum("c").alias("in_slice")) \
        .select(*g, "prob_id", "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("before"))  # at most SLICES + 1 rows each
    placed = _ns_join(counts.where(F.col("slice") >= 0).withColumn("upto", F.sum("c").over(inside)), slices, [*g, "prob_id", "slice"])
    wants = brackets.select(*g, F.explode("want").alias("w")).select(*g, "w.prob_id", "w.prob", "w.klo", "w.khi", "w.frac")
    placed = _ns_join(placed, wants, [*g, "prob_id"])
    last = F.col("before") + F.col("upto")
    holds = lambda k: F.max(F.when((F.col(k) <= last) & (F.col(k) > last - F.col("c")), F.col("v")))
    out = placed.groupBy(*g, "prob_id", "prob", "frac").agg(holds("klo").alias("vlo"), holds("khi").alias("vhi"))
    lost = F.raise_error(F.lit("a rank lies outside its bracket: raise the accuracy")).cast("double")
    value = F.when(F.col("vlo").isNull() | F.col("vhi").isNull(), lost).when(F.col("vlo") == F.col("vhi"), F.col("vlo")) \
        .otherwise(F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac"))
    return out.select(*g, "prob_id", "prob", value.alias("value"))


def _slice(x, low, high):
    """Slice of a value in its bracket: 0 .. SLICES - 1, monotone."""
    # halves, and finite stand-ins for infinities, keep the span finite
    half = lambda c: F.least(F.greatest(c, F.lit(-_MAX)), F.lit(_MAX)) / 2
    share = F.coalesce(F.try_divide(half(x) - half(low), half(high) - half(low)), F.lit(0.0))
    return F.least(F.floor(share * F.lit(float(SLICES))), F.lit(SLICES - 1)).cast("int")


def exact_median(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                 alias: str = "median", **kw) -> DataFrame:
    """A3 / A4: exact interpolated median per group (one row per non-empty group)."""
    q = exact_quantiles(df, value_col, [0.5], group_cols, **kw)
    return q.select(*group_cols, F.col("value").alias(alias))


def exact_medians_many(df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = (),
                       **kw) -> DataFrame:
    """Medians of several columns in one run: unpivot to (column, value), group by it.

    Returns ``group_cols + ['measure', 'median']``.
    """
    long = unpivot(df, value_cols, group_cols)
    return exact_median(long, "value", list(group_cols) + ["measure"], few=not group_cols, **kw)


def unpivot(df: DataFrame, value_cols: Sequence[str], keep: Sequence[str] = (),
            name_col: str = "measure", value_col: str = "value") -> DataFrame:
    """Stack columns into (name, double value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(c).cast("double").alias(value_col))
                      for c in value_cols])
    return df.select(*keep, F.explode(pairs).alias("_kv")).select(*keep, f"_kv.{name_col}", f"_kv.{value_col}")
