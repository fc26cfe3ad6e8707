"""Evaluation tables.

Predictions are kept long: one row per (model, row) with ``y`` and ``pred``,
so every model is scored in the same scan and metric tables stack by union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.numeric import round_half_even
from agrolith.operators.quantile import exact_quantiles
from agrolith.session import stage_table


def long_predictions(df: DataFrame, y: str, preds: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide prediction columns -> (model, keep..., y, pred)."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred"))
                    for m, c in preds.items()])
    return df.select(*keep, F.col(y).cast("double").alias("y"), F.explode(arr).alias("p")) \
        .select("p.model", *keep, "y", "p.pred")


def regression_metrics(long: DataFrame, places: int | None = 4, by: Sequence[str] = ("model",)) -> DataFrame:
    """N, MAE, RMSE, R^2 per model."""
    e = F.col("y") - F.col("pred")
    out = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))
    if places is not None:
        for c in ("mae", "rmse", "r2"):
            out = out.withColumn(c, round_half_even(c, places))
    return out


def rank_models(metrics: DataFrame, by: str = "rmse") -> DataFrame:
    """Rank 1..k by the metric, ties by model name (one row per model)."""
    w = Window.orderBy(F.col(by), F.col("model"))  # a metric table has one row per model
    return metrics.withColumn("rank", F.row_number().over(w))


def best_model(metrics: DataFrame, by: str = "rmse") -> DataFrame:
    """Model with the smallest metric (ties to the smaller name)."""
    return metrics.agg(F.min_by("model", F.struct(F.col(by), F.col("model"))).alias("best_model"),
                       F.min(by).alias(f"best_{by}"))


def improvement(metrics: DataFrame, baseline: str) -> DataFrame:
    """Absolute and % reduction of MAE and RMSE against the baseline model."""
    b = metrics.where(F.col("model") == baseline).select(F.col("mae").alias("b_mae"), F.col("rmse").alias("b_rmse"))
    j = metrics.crossJoin(b)  # one baseline row
    return j.select("model", "mae", "rmse",
                    round_half_even(F.col("b_mae") - F.col("mae"), 4).alias("mae_gain"),
                    round_half_even(F.try_divide(F.col("b_mae") - F.col("mae"), F.col("b_mae")) * 100, 2).alias("mae_gain_pct"),
                    round_half_even(F.col("b_rmse") - F.col("rmse"), 4).alias("rmse_gain"),
                    round_half_even(F.try_divide(F.col("b_rmse") - F.col("rmse"), F.col("b_rmse")) * 100, 2).alias("rmse_gain_pct"))


def residuals(long: DataFrame) -> DataFrame:
    """residual = y - pred."""
    return long.withColumn("residual", F.col("y") - F.col("pred"))


def binned_mean(df: DataFrame, feature: str, value: str, bins: int = 10) -> DataFrame:
    """Mean of ``value`` per equal-width bin of ``feature`` (bins 1..bins)."""
    r = df.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    j = df.crossJoin(r)  # one-row range
    hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") + 1)
    b = F.least(F.floor((F.col(feature) - F.col("_lo")) / (hi - F.col("_lo")) * bins), F.lit(bins - 1)) + 1
    return j.withColumn("bin", b.cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
        F.min(feature).alias("feature_min"), F.max(feature).alias("feature_max"))


def histogram_density(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram plus a Gaussian density at each bin centre.

    The density is a kernel estimate from the binned counts (Scott's rule
    bandwidth), so its cost is bins x bins, not rows x grid.
    """
    st = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"),
                F.stddev_samp(value).alias("_sd"))
    j = df.where(F.col(value).isNotNull()).crossJoin(st)  # one-row range
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    h = j.withColumn("bin", F.coalesce(b, F.lit(0))).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    h = h.crossJoin(st).withColumn("center", F.col("_lo") + (F.col("bin") + F.lit(0.5)) * width) \
        .withColumn("bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    o = h.select(F.col("bin").alias("obin"), F.col("center").alias("ocenter"), F.col("count").alias("ocount"))
    k = h.crossJoin(o)  # bins x bins, bounded by the bin count
    z = (F.col("center") - F.col("ocenter")) / F.col("bw")
    dens = k.groupBy("bin", "center", "count", "_n", "bw").agg(
        F.sum(F.col("ocount") * F.exp(-0.5 * z * z)).alias("_s"))
    return dens.select("bin", round_half_even("center", 6).alias("center"), "count",
                       round_half_even(F.col("_s") / (F.col("_n") * F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5)), 6)
                       .alias("density"))


def kernel_density(df: DataFrame, value: str, points: int = 200, reach: float = 8.0) -> DataFrame:
    """Gaussian density (Scott's bandwidth) on ``points`` even places from the smallest to the largest value.

    Linear binning: a value is shared between the two grid points around it, so
    one aggregate reduces the rows to ``points`` weights; the kernel sum runs
    over the grid and skips pairs more than ``reach`` bandwidths apart. Every
    point has a row, with rows of the table near it or not. A column of one
    value has no density (null); one without values gives no rows.
    """
    st = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")) \
        .where(F.col("_n") > 0).withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))) \
        .withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    at = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_step")), F.lit(0.0))
    low = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    bins = df.where(F.col(value).isNotNull()).crossJoin(st).groupBy(low.alias("_low")).agg(  # one-row statistics
        F.sum(F.lit(1.0) - (at - low)).alias("_w0"), F.sum(at - low).alias("_w1"))
    pairs = F.array(F.struct(F.col("_low").alias("k"), F.col("_w0").alias("w")), F.struct((F.col("_low") + 1).alias("k"), F.col("_w1").alias("w")))
    weights = bins.select(F.explode(pairs).alias("x")).groupBy(F.col("x.k").alias("_k")).agg(F.sum("x.w").alias("_w"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "point").crossJoin(st)
    z = F.try_divide((F.col("point") - F.col("_k")) * F.col("_step"), F.col("_bw"))
    near = F.abs(F.col("point") - F.col("_k")) * F.col("_step") <= F.lit(reach) * F.col("_bw")
    out = grid.join(F.broadcast(weights), near, "left").groupBy("point", "_lo", "_step", "_n", "_bw").agg(  # points x points
        F.coalesce(F.sum(F.col("_w") * F.exp(-0.5 * z * z)), F.lit(0.0)).alias("_s"))
    return out.select("point", round_half_even(F.col("_lo") + F.col("point") * F.col("_step"), 6).alias("place"), round_half_even(
        F.try_divide(F.col("_s"), F.col("_n") * F.col("_bw") * F.lit((2 * 3.141592653589793) ** 0.5)), 6).alias("density"))


def box_summary(df: DataFrame, group: str, value: str, places: int = 4) -> DataFrame:
    """Quartiles and whiskers (furthest points within 1.5 IQR) per group."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], [group], staged=True)
    qw = q.groupBy(group).pivot("prob_id", [0, 1, 2]).agg(F.first("value")) \
        .select(group, F.col("0").alias("q1"), F.col("1").alias("median"), F.col("2").alias("q3"))
    qw = stage_table(qw, "quartiles")  # a row per group
    j = df.select(group, value).join(qw, group)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    out = j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    for c in ("q1", "median", "q3", "whisker_low", "whisker_high"):
        out = out.withColumn(c, round_half_even(c, places))
    return out


def cv_pivot(cv: DataFrame, row: str = "C", col: str = "gamma", slice_col: str = "eps",
             score: str = "rmse", places: int = 4) -> DataFrame:
    """Mean score, rows x columns, one block per slice value.

    The column axis values come from a distinct over the (small) grid table;
    column ``<col>_<i>`` is the i-th of them in order.
    """
    axis = [r[0] for r in cv.select(col).distinct().orderBy(col).collect()]  # grid axis: a handful of values
    mean = cv.groupBy(slice_col, row).pivot(col, axis).agg(F.avg(score))
    return mean.select(slice_col, row, *[round_half_even(F.col(f"`{v}`"), places).alias(f"{col}_{i}") for i, v in enumerate(axis)])


def grid_range(cv: DataFrame, score: str = "rmse") -> DataFrame:
    """Smallest and largest mean score over the grid, and the setting with the smallest."""
    m = cv.groupBy("C", "gamma", "eps").agg(F.avg(score).alias("s"))
    key = F.struct("s", "C", "gamma", "eps")
    return m.agg(round_half_even(F.min("s"), 4).alias("min_score"), round_half_even(F.max("s"), 4).alias("max_score"),
                 *[F.min_by(c, key).alias(f"best_{c}") for c in ("C", "gamma", "eps")])
