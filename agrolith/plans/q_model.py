"""Registered queries: metrics, ranking, residuals, CV tables, permutation importance.

Predictions come from fixed-weight linear models over the standardised
features (scaler fitted on the train part), so a second engine can recompute
every number. The same table functions serve the fitted regressors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.numeric import round_half_even
from agrolith.operators import metrics as M
from agrolith.operators import scale as SC
from agrolith.operators.importance import importance_summary, permutation_importance
from agrolith.operators.score import linear_score, linear_scores
from agrolith.plans import stage as ST
from agrolith.plans.registry import register
from agrolith.plans.tables import SQL_FILLED, SQL_FINAL, SQL_SOURCES
from agrolith.session import stage_table

MF = "WITH " + SQL_SOURCES + "," + SQL_FILLED + "," + SQL_FINAL + "," + ST.SQL_MF
FEATS = ST.FEATURES
# Weights of the reference-free linear scorers used to check the tables.
FIXED_MODELS = {
    "fixed_a": {"rain": 0.30, "temp": 0.20, "pest": -0.10, "country_code": 0.05, "crop_code": 0.15},
    "fixed_b": {"rain": 0.10, "temp": 0.40},
    "mean": {},
}


def fixed_scaler(mf):
    return SC.fit(mf.where(F.col("part") == "train"), FEATS, "standard")


def train_mean(mf):
    return mf.where(F.col("part") == "train").agg(F.avg("y").alias("_ybar"))


def fixed_predictions(spark, d, part: str | None = "test", keep=("order_key", "crop", "y"), models=None):
    """Long predictions (model, keep..., y, pred) of the fixed models (or of ``models``); the rows are scaled once."""
    mf = ST.model_frame(spark, d)
    rows = mf if part is None else mf.where(F.col("part") == part)
    names = list(models or FIXED_MODELS)
    rows = linear_scores(rows.crossJoin(train_mean(mf)), fixed_scaler(mf),  # one-row mean
                         {f"pred_{m}": FIXED_MODELS[m] for m in names}, F.col("_ybar"))
    return M.long_predictions(rows, "y", {m: f"pred_{m}" for m in names},
                              keep=[k for k in keep if k != "y"] + [c for c in FEATS if c not in keep])


def _z(c):
    return f"(m.{c} - st.a_{c}) / st.b_{c}"


def _pred_sql(w):
    expr = "st.ybar"
    for c, v in w.items():
        expr = f"({expr} + {_z(c)} * {v})"
    return expr


SQL_PRED = ",\nst AS (SELECT avg(y) AS ybar, " + ", ".join(
    f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS b_{c}" for c in FEATS) + \
    " FROM mf WHERE part = 'train'),\nlp AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, m.order_key, m.crop, m.y, {_pred_sql(w)} AS pred, m.rain, m.temp, m.pest, "
    f"m.country_code, m.crop_code FROM mf m, st WHERE m.part = 'test'" for m, w in FIXED_MODELS.items()) + ")\n"

METRICS_SQL = """
mt AS (SELECT model, count(*) AS n, round_even(avg(abs(y - pred)) * 1e4, 0) / 1e4 AS mae,
              round_even(sqrt(avg((y - pred) * (y - pred))) * 1e4, 0) / 1e4 AS rmse,
              round_even((1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))) * 1e4, 0) / 1e4 AS r2
       FROM lp GROUP BY model)"""


@register("regression_metrics", MF + SQL_PRED + "," + METRICS_SQL + "\nSELECT * FROM mt")
def regression_metrics(spark, d):
    """N, MAE, RMSE, R^2 per model on the test part, one scan for all models."""
    return M.regression_metrics(fixed_predictions(spark, d))


@register("r2_score", MF + SQL_PRED + "," + METRICS_SQL + "\nSELECT model, r2 FROM mt")
def r2_score(spark, d):
    """Coefficient of determination per model."""
    return M.regression_metrics(fixed_predictions(spark, d)).select("model", "r2")


@register("rank_models", MF + SQL_PRED + "," + METRICS_SQL +
          "\nSELECT model, rmse, mae, CAST(row_number() OVER (ORDER BY rmse, model) AS BIGINT) AS rank FROM mt")
def rank_models(spark, d):
    """Models ranked by RMSE (ties by name)."""
    return M.rank_models(M.regression_metrics(fixed_predictions(spark, d))).select("model", "rmse", "mae", "rank")


@register("best_model", MF + SQL_PRED + "," + METRICS_SQL +
          "\nSELECT arg_min(model, (rmse, model)) AS best_model, min(rmse) AS best_rmse FROM mt")
def best_model(spark, d):
    """The model with the smallest RMSE."""
    return M.best_model(M.regression_metrics(fixed_predictions(spark, d)))


@register("model_improvement", MF + SQL_PRED + "," + METRICS_SQL + """,
b AS (SELECT mae AS b_mae, rmse AS b_rmse FROM mt WHERE model = 'mean')
SELECT model, mae, rmse, round_even((b_mae - mae) * 1e4, 0) / 1e4 AS mae_gain,
       round_even((b_mae - mae) / b_mae * 100 * 100, 0) / 100 AS mae_gain_pct,
       round_even((b_rmse - rmse) * 1e4, 0) / 1e4 AS rmse_gain,
       round_even((b_rmse - rmse) / b_rmse * 100 * 100, 0) / 100 AS rmse_gain_pct
FROM mt, b""")
def model_improvement(spark, d):
    """MAE / RMSE reduction (absolute and %) of each model against the mean baseline."""
    return M.improvement(M.regression_metrics(fixed_predictions(spark, d)), "mean")


def _bins_sql(x):
    return MF + SQL_PRED + f""",
r AS (SELECT {x} AS x, y - pred AS residual FROM lp WHERE model = 'fixed_a'),
rg AS (SELECT min(x) AS lo, CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1 END AS hi FROM r)
SELECT CAST(least(floor((x - lo) / (hi - lo) * 10), 9) + 1 AS BIGINT) AS bin, count(*) AS n,
       round_even(avg(residual) * 1e4, 0) / 1e4 AS mean_value, round_even(min(x) * 1e6, 0) / 1e6 AS feature_min,
       round_even(max(x) * 1e6, 0) / 1e6 AS feature_max
FROM r, rg GROUP BY 1"""


def _residual_bins(x):
    def q(spark, d):
        out = M.binned_mean(M.residuals(fixed_predictions(spark, d, models=["fixed_a"])), x, "residual", 10)
        return out.select("bin", "n", *[round_half_even(c, k).alias(c) for c, k in (("mean_value", 4), ("feature_min", 6), ("feature_max", 6))])
    q.__doc__ = f"M15: mean residual of fixed_a per equal-width bin of {x} (10 bins)."
    return q


for _name, _x in (("residual_bins", "rain"), ("residual_by_temperature", "temp"), ("residual_by_fitted", "pred")):
    register(_name, _bins_sql(_x))(_residual_bins(_x))


_ROW_KEY = "CAST(order_key AS VARCHAR) || '|' || crop || '|' || CAST(CAST(round_even(y * 1e4, 0) AS BIGINT) AS VARCHAR)"


@register("residual_sample", MF + SQL_PRED + f"""
SELECT order_key, y, round_even(pred * 1e4, 0) / 1e4 AS pred, round_even((y - pred) * 1e4, 0) / 1e4 AS residual
FROM lp WHERE model = 'fixed_a' ORDER BY md5('13|' || {_ROW_KEY}) LIMIT 500""")
def residual_sample(spark, d):
    """The residual table of 500 test rows, chosen by md5 order."""
    from agrolith.operators.sample import sample_n
    lp = M.residuals(fixed_predictions(spark, d, models=["fixed_a"]))
    s = sample_n(lp, ["order_key", "crop", F.rint(F.col("y") * F.lit(1e4)).cast("bigint")], 500, seed=13)
    return s.select("order_key", "y", round_half_even("pred", 4).alias("pred"), round_half_even("residual", 4).alias("residual"))


# ---- tabular, image and fused scores side by side ------------------------------------------

def modality_predictions(spark, d):
    """(model, y, pred): the tabular score, the image score of the row's vector, and their fusion, per test row."""
    from agrolith.operators import score as SCR
    from agrolith.plans.q_score import image_scores
    tab = fixed_predictions(spark, d, models=["fixed_a"]).select("order_key", "y", F.col("pred").alias("tabular"))
    img = image_scores(spark, d)
    n = img.agg(F.max("image_id").alias("_top"))  # one row
    j = tab.crossJoin(n).withColumn("image_id", F.pmod("order_key", F.col("_top") + 2)).join(img, "image_id", "left")
    j = j.withColumn("fused", SCR.fuse(F.col("tabular"), F.col("image")))
    return M.long_predictions(j, "y", {"Tabular only": "tabular", "Image only": "image", "Fused": "fused"}).where(F.col("pred").isNotNull())


def _modality_sql():
    from agrolith.functions.numeric import fixed_logits_sql
    return MF + SQL_PRED + f""",
lgt AS (SELECT vec_id, {fixed_logits_sql('embedding', 2)} AS lg FROM embeddings),
img AS (SELECT vec_id, round_even(exp(lg[1] - greatest(lg[1], lg[2])) / (exp(lg[1] - greatest(lg[1], lg[2])) + exp(lg[2] - greatest(lg[1], lg[2])))
                                  * 60.0 * 1e4, 0) / 1e4 AS image FROM lgt),
w AS (SELECT y, pred AS tabular, image, pred * 0.7 + coalesce(image, pred * 0.95) * 0.3 AS fused
      FROM lp LEFT JOIN img ON img.vec_id = lp.order_key % ((SELECT max(vec_id) FROM embeddings) + 2) WHERE lp.model = 'fixed_a'),
l3 AS (SELECT 'Tabular only' AS model, y, tabular AS pred FROM w UNION ALL SELECT 'Image only', y, image FROM w WHERE image IS NOT NULL
       UNION ALL SELECT 'Fused', y, fused FROM w),
mt AS (SELECT model, count(*) AS n, round_even(avg(abs(y - pred)) * 1e4, 0) / 1e4 AS mae, round_even(sqrt(avg((y - pred) * (y - pred))) * 1e4, 0) / 1e4 AS rmse,
              round_even((1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))) * 1e4, 0) / 1e4 AS r2 FROM l3 GROUP BY model)
"""


@register("modality_compare", _modality_sql() + "SELECT *, CAST(row_number() OVER (ORDER BY rmse, model) AS BIGINT) AS rank FROM mt")
def modality_compare(spark, d):
    """Tabular only, image only and fused scored on the same test rows, ranked."""
    return M.rank_models(M.regression_metrics(modality_predictions(spark, d)))


@register("residual_histogram", MF + SQL_PRED + """,
r AS (SELECT y - pred AS v FROM lp WHERE model = 'fixed_a'),
st2 AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, stddev_samp(v) AS sd FROM r),
h AS (SELECT coalesce(CAST(least(floor((v - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER), 0) AS bin, count(*) AS cnt
      FROM r, st2 GROUP BY 1),
hc AS (SELECT bin, cnt, lo + (bin + 0.5) * ((hi - lo) / 20.0) AS center, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM h, st2)
SELECT a.bin AS bin, round_even(a.center * 1e6, 0) / 1e6 AS center, a.cnt AS count,
       round_even(sum(b.cnt * exp(-0.5 * ((a.center - b.center) / a.bw) * ((a.center - b.center) / a.bw)))
                  / (a.n * a.bw * sqrt(2 * pi())) * 1e6, 0) / 1e6 AS density
FROM hc a, hc b GROUP BY a.bin, a.center, a.cnt, a.n, a.bw""")
def residual_histogram(spark, d):
    """Residual histogram (20 bins) with a kernel density at each bin centre."""
    lp = M.residuals(fixed_predictions(spark, d, models=["fixed_a"]))
    return M.histogram_density(lp, "residual", 20).withColumn("bin", F.col("bin").cast("long"))


@register("box_summary", MF + SQL_PRED + """,
r AS (SELECT crop, y - pred AS v FROM lp WHERE model = 'fixed_a'),
q AS (SELECT crop, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY crop)
SELECT r.crop, round_even(q1 * 1e4, 0) / 1e4 AS q1, round_even(med * 1e4, 0) / 1e4 AS median, round_even(q3 * 1e4, 0) / 1e4 AS q3,
  round_even(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) * 1e4, 0) / 1e4 AS whisker_low,
  round_even(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) * 1e4, 0) / 1e4 AS whisker_high,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM r JOIN q ON r.crop = q.crop GROUP BY r.crop, q1, med, q3""")
def box_summary(spark, d):
    """Quartiles, whiskers and outlier count of fixed_a residuals per crop."""
    lp = M.residuals(fixed_predictions(spark, d, models=["fixed_a"]))
    return M.box_summary(lp, "crop", "residual")


# ---- axes of the parameter grid ---------------------------------------------------------
# The grid axes of the reference's search; gamma "scale" is
# 1 / (features x variance) = 1/5 for five standardised features.
GRID_C = [1.0, 10.0, 100.0]
GRID_GAMMA = [0.2, 0.01, 0.1]
GRID_EPS = [0.1, 0.5, 1.0]


# ---- permutation importance ------------------------------------------------------------

def perm_frame(spark, d):
    mf = ST.model_frame(spark, d)
    test = mf.where(F.col("part") == "test").select(
        "order_key", "crop", "y", *FEATS, F.rint(F.col("y") * 1e4).cast("bigint").alias("y_key"))
    return mf, test


def _perm_predict(mf):
    sc = fixed_scaler(mf)
    row = stage_table(sc.stats.crossJoin(train_mean(mf)), "scorer")  # one row
    sc, ybar = SC.Scaler(sc.method, sc.cols, row.drop("_ybar")), row.select("_ybar")

    def predict(df):
        return linear_score(df.crossJoin(ybar), sc, FIXED_MODELS["fixed_a"], F.col("_ybar")).drop("_ybar")
    return predict


PERM_KEY = "CAST(order_key AS VARCHAR) || '|' || crop || '|' || CAST(y_key AS VARCHAR)"


def _once_sql(x, repeat):
    """The Feistel rounds of :func:`agrolith.operators.rank.permuted` on the SQL expression ``x``, over an a x b grid."""
    left, right = f"(({x}) // b)", f"(({x}) % b)"
    for i in range(4):
        noise = lambda v, i=i: f"('0x' || substr(md5('0|{repeat}|{i}|' || CAST({v} AS VARCHAR)), 1, 8))::BIGINT"
        if i % 2 == 0:
            left = f"(({left} + {noise(right)}) % a)"
        else:
            right = f"(({right} + {noise(left)}) % b)"
    return f"({left} * b + {right})"


def perm_mates_sql():
    """CTEs te, rk (rank), ab (the grid) and j0.. (each row with its partner's features as p_*), after the model frame."""
    cols = ", ".join(f"m.{c} AS p_{c}" for c in FEATS)
    mates = []
    for r in range(5):
        to = f"list_reduce(list_prepend({_once_sql('rank', r)}, range(0, a * b - n + 1)), lambda x, i: CASE WHEN x < n THEN x ELSE {_once_sql('x', r)} END)"
        mates.append(f"t{r} AS (SELECT rk.*, {to} AS mate FROM rk, ab),\nj{r} AS (SELECT o.*, {cols} FROM t{r} o JOIN rk m ON m.rank = o.mate)")
    return f""",
te AS (SELECT order_key, crop, y, rain, temp, pest, country_code, crop_code, CAST(round_even(y * 1e4, 0) AS BIGINT) AS y_key FROM mf WHERE part = 'test'),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('1|' || {PERM_KEY}), {', '.join(FEATS)}, y) - 1 AS rank FROM te),
ab AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM te))),
{', '.join(mates)}"""


def _perm_sql():
    feats = []
    for r in range(5):
        for f in FEATS:
            expr = "st.ybar"
            for c, v in FIXED_MODELS["fixed_a"].items():
                col = f"m.p_{c}" if c == f else f"m.{c}"
                expr = f"({expr} + ({col} - st.a_{c}) / st.b_{c} * {v})"
            feats.append(f"SELECT '{f}' AS feature, {r} AS repeat, 1 - sum((m.y - {expr}) * (m.y - {expr})) / "
                         f"(var_pop(m.y) * count(*)) AS r2 FROM j{r} m, st")
    base_expr = _pred_sql(FIXED_MODELS["fixed_a"])
    return (MF + SQL_PRED.split(",\nlp AS")[0] + perm_mates_sql() + f""",
rb AS (SELECT 1 - sum((m.y - {base_expr}) * (m.y - {base_expr})) / (var_pop(m.y) * count(*)) AS r2_base FROM te m, st),
rp AS ({' UNION ALL '.join(feats)}),
im AS (SELECT feature, CAST(repeat AS BIGINT) AS repeat, round_even((r2_base - r2) * 1e4, 0) / 1e4 AS importance FROM rp, rb)
""")


def staged_importance(spark, d):
    """The importances of fixed_a, computed once per application and read by the tables over them."""
    def build():
        mf, test = perm_frame(spark, d)
        return permutation_importance(test, FEATS, _perm_predict(mf), "y", ["order_key", "crop", "y_key"], repeats=5)
    return ST.stage(spark, d, "importance", build)


@register("permutation_importance", _perm_sql() + "SELECT * FROM im")
def perm_importance(spark, d):
    """R^2 drop of fixed_a when one feature is permuted over the whole test part, 5 repeats."""
    mf, test = perm_frame(spark, d)
    return permutation_importance(test, FEATS, _perm_predict(mf), "y", ["order_key", "crop", "y_key"], repeats=5)


@register("importance_summary", _perm_sql() + """,
s AS (SELECT feature, round_even(avg(importance) * 1e4, 0) / 1e4 AS mean_importance,
             round_even(stddev_pop(importance) * 1e4, 0) / 1e4 AS std_importance FROM im GROUP BY feature)
SELECT *, CAST(row_number() OVER (ORDER BY mean_importance DESC, feature) AS BIGINT) AS rank FROM s""")
def perm_summary(spark, d):
    """Mean and spread of importance per feature, ordered."""
    return importance_summary(staged_importance(spark, d))


@register("importance_box", _perm_sql() + """,
q AS (SELECT feature, quantile_cont(importance, 0.25) AS q1, quantile_cont(importance, 0.5) AS med, quantile_cont(importance, 0.75) AS q3 FROM im GROUP BY feature)
SELECT im.feature, round_even(q1 * 1e4, 0) / 1e4 AS q1, round_even(med * 1e4, 0) / 1e4 AS median, round_even(q3 * 1e4, 0) / 1e4 AS q3,
  round_even(min(CASE WHEN importance >= q1 - 1.5 * (q3 - q1) AND importance <= q3 + 1.5 * (q3 - q1) THEN importance END) * 1e4, 0) / 1e4 AS whisker_low,
  round_even(max(CASE WHEN importance >= q1 - 1.5 * (q3 - q1) AND importance <= q3 + 1.5 * (q3 - q1) THEN importance END) * 1e4, 0) / 1e4 AS whisker_high,
  count(*) FILTER (WHERE NOT (importance >= q1 - 1.5 * (q3 - q1) AND importance <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM im JOIN q ON im.feature = q.feature GROUP BY im.feature, q1, med, q3""")
def importance_box(spark, d):
    """Quartiles, whiskers and outliers of the importances per feature."""
    return M.box_summary(staged_importance(spark, d), "feature", "importance")
