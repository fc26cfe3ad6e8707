"""Registered queries: kernel regressors, grid search, refit, vector classifier.

Fits are iterative, so no SQL computes them anew; but SQL can hold them to
account. ``svr_gap`` stores each fitted model as tables, and its twin reads
these and recomputes primal, dual and gap over the train part: a small gap
proves the fit, however it was found. ``score_stored_model`` has its twin score
with the stored RBF model. One evaluation at fixed weights has twins as well
(``svr_eval_*``, ``grid_eval``), and the CV tables are built from the latter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from agrolith.functions.numeric import argmax, fixed_logits, fixed_logits_sql, round_half_even, softmax
from agrolith.operators import metrics as M
from agrolith.operators.importance import permutation_importance
from agrolith.operators.kernel import feature_rows, landmark_map, make_map, pick_landmarks, poly_map
from agrolith.operators.network import TwoLayer, network_pass
from agrolith.operators.regress import SVRFit, duality_gap, evaluate, fit_svr, fold_scores, predict, training_blocks
from agrolith.operators.sample import hash_split
from agrolith.plans import stage as ST
from agrolith.plans import tables as TB
from agrolith.plans.q_model import (
    _ROW_KEY, GRID_C, GRID_EPS, GRID_GAMMA, METRICS_SQL, MF, SQL_PRED, _z, fixed_scaler, perm_frame, perm_mates_sql)
from agrolith.plans.q_prepare import row_key_cols
from agrolith.plans.registry import register
from agrolith.session import checkpoint_dir, stage_table
from agrolith.sources.store import load_model, save_model

FEATS = ST.FEATURES
# Default settings of the three kernels (gamma None = "scale").
KERNELS = {
    "Linear": {"kind": "linear", "C": 1.0, "eps": 0.1},
    "RBF": {"kind": "rbf", "C": 10.0, "eps": 0.1, "gamma": None},
    "Polynomial": {"kind": "poly", "C": 1.0, "eps": 0.1, "degree": 3, "coef0": 1.0, "gamma": None},
}
#: Share of the kernel's trace that the RBF map may miss.
RBF_TOL = 0.02


def zframe(spark, d):
    """Model frame with features standardised by the train-part statistics (no leakage)."""
    mf = ST.model_frame(spark, d)
    return fixed_scaler(mf).transform(mf)


class RBFMaps:
    """The RBF maps of one train part by their gamma, each grown once, over feature rows that are counted once."""

    def __init__(self, train):
        self.train, self.rows, self.by_gamma = train, None, {}

    def get(self, gamma=None):
        gamma = 1.0 / len(FEATS) if gamma is None else float(gamma)
        if gamma not in self.by_gamma:
            self.rows = feature_rows(self.train, FEATS) if self.rows is None else self.rows
            self.by_gamma[gamma] = make_map("rbf", self.train, FEATS, gamma=gamma, tol=RBF_TOL, rows=self.rows)
        return self.by_gamma[gamma]


def _map(train, name, gamma=None):
    k = KERNELS[name]
    return make_map(k["kind"], train, FEATS, gamma=gamma or k.get("gamma"), degree=k.get("degree", 3), coef0=k.get("coef0", 1.0), tol=RBF_TOL)


def _fit(train, name, cache=None, fmap=None, **other):
    """A default kernel fitted on ``train``; ``other``: C, eps or gamma in place of the default ones; ``fmap``: its map, if it is there."""
    k = KERNELS[name]
    fmap = _map(train, name, other.get("gamma")) if fmap is None else fmap
    return fit_svr(train, FEATS, "y", fmap, other.get("C", k["C"]), other.get("eps", k["eps"]), cache=cache)


def _metrics_row(spark, test, fit, name):
    p = predict(test, FEATS, fit, in_workers=True).select("y", "pred")
    m = M.regression_metrics(p.withColumn("model", F.lit(name)))
    return m.withColumns({"iterations": F.lit(int(fit.iterations[0])), "objective": F.lit(float(round(fit.objective[0], 6))),
                          "gap": F.lit(float(fit.gap[0])), "rank": F.lit(fit.fmap.dim_out), "kernel_error": F.lit(float(fit.fmap.error))})


def _single(name):
    def q(spark, d):
        z = zframe(spark, d)
        train, test = z.where(F.col("part") == "train"), z.where(F.col("part") == "test")
        cache = training_blocks(train, FEATS, "y")
        fit = _fit(train, name, cache)
        cache.unpersist()
        return _metrics_row(spark, test, fit, name)
    q.__doc__ = f"M1-M3: {name} kernel regressor fitted on the train part, scored on the test part."
    return q


for _q, _n in [("svr_linear", "Linear"), ("svr_poly", "Polynomial"), ("svr_rbf", "RBF")]:
    register(_q)(_single(_n))


@register("kernel_compare")
def kernel_compare(spark, d):
    """The three kernels on one split; long predictions, metrics, rank by RMSE."""
    z = zframe(spark, d)
    train, test = z.where(F.col("part") == "train"), z.where(F.col("part") == "test")
    cache = training_blocks(train, FEATS, "y")
    preds = None
    for name in KERNELS:
        fit = _fit(train, name, cache)
        p = predict(test.select("y", *FEATS), FEATS, fit).select(F.lit(name).alias("model"), "y", "pred")
        preds = p if preds is None else preds.unionByName(p)
    cache.unpersist()
    return M.rank_models(M.regression_metrics(preds))


def cv_table(spark, d, gap_tol=1e-3, cache=None, maps=None):
    """M5: 27 settings x 3 folds; per gamma one map and one joint run of its 27 models, each with its own stop test.

    ``cache`` and ``maps``: the packed train rows (with folds) and their maps, of a caller who goes on with them.
    """
    z = zframe(spark, d)
    train = z.where(F.col("part") == "train")
    maps, own = RBFMaps(train) if maps is None else maps, cache is None
    cache = training_blocks(train, FEATS, "y", "fold") if own else cache
    rows = []
    for g in GRID_GAMMA:
        fmap = maps.get(g)
        settings = [(c, e, f) for c in GRID_C for e in GRID_EPS for f in range(3)]
        fit = fit_svr(train, FEATS, "y", fmap, [s[0] for s in settings], [s[1] for s in settings],
                      fold_col="fold", model_folds=[s[2] for s in settings], cache=cache, gap_tol=gap_tol)
        sc = fold_scores(cache, FEATS, "y", "fold", fit)
        for (c, e, f), (te, tr), n, gap in zip(settings, sc, fit.iterations, fit.gap):
            rows.append((float(c), float(g), float(e), int(f), float(te), float(tr), int(n), float(gap), fmap.dim_out, float(fmap.error)))
    if own:
        cache.unpersist()
    return spark.createDataFrame(rows, "C double, gamma double, eps double, fold int, test_rmse double, train_rmse double, "
                                       "iterations int, gap double, rank int, kernel_error double")


def staged_cv(spark, d, **have):
    """The CV table, computed once per application and read by the grid and refit queries; ``have``: see ``cv_table``."""
    return ST.stage(spark, d, "cv_table", lambda: cv_table(spark, d, **have))


@register("grid_search")
def grid_search(spark, d):
    """M5 / M8: cross-validated RMSE for every (C, gamma, eps) and fold, train and test score, scans and duality gap kept."""
    return staged_cv(spark, d).withColumn("test_rmse", round_half_even("test_rmse", 4)) \
        .withColumn("train_rmse", round_half_even("train_rmse", 4))


@register("refit_best")
def refit_best(spark, d):
    """Best setting by mean CV RMSE, refit on the train part, compared with the default RBF."""
    z = zframe(spark, d)
    train, test = z.where(F.col("part") == "train"), z.where(F.col("part") == "test")
    cache, maps = training_blocks(train, FEATS, "y", "fold"), RBFMaps(train)  # for the grid, if it is still to be run, and both fits
    cv = staged_cv(spark, d, cache=cache, maps=maps)
    best = cv.groupBy("C", "gamma", "eps").agg(F.avg("test_rmse").alias("s")) \
        .agg(F.min_by(F.struct("C", "gamma", "eps"), F.struct("s", "C", "gamma", "eps")).alias("b")).first()["b"]
    tuned = _fit(train, "RBF", cache, maps.get(best["gamma"]), C=best["C"], eps=best["eps"])
    base = _fit(train, "RBF", cache, maps.get(KERNELS["RBF"]["gamma"]))
    cache.unpersist()
    m = _metrics_row(spark, test, base, "RBF default").unionByName(_metrics_row(spark, test, tuned, "RBF tuned"))
    m = stage_table(m, "refit-metrics")  # two rows, read three times
    imp = M.improvement(m, "RBF default")
    imp = imp.join(F.broadcast(m.select("model", "iterations", "gap")), "model")  # two rows
    return imp.withColumn("best_C", F.lit(best["C"])).withColumn("best_gamma", F.lit(best["gamma"])) \
        .withColumn("best_eps", F.lit(best["eps"]))


# ---- one evaluation at fixed weights, with twins ----------------------------------

EVAL_LANDMARKS = 8


def fixed_weight(k: int) -> float:
    """Fixed weight of term k: a binary fraction between -5/16 and 5/16."""
    return ((k * 7) % 11 - 5) / 16


FIXED_B = 1.0


def _eval_map(name, train):
    k = KERNELS[name]
    if name == "RBF":
        return landmark_map(pick_landmarks(train, FEATS, EVAL_LANDMARKS, 42, row_key_cols()), 0.2)
    return make_map(k["kind"], None, FEATS, gamma=k.get("gamma"), degree=k.get("degree", 3), coef0=k.get("coef0", 1.0))


_TRAIN_SQL = MF + SQL_PRED.split(",\nlp AS")[0] + """,
tr AS (SELECT m.order_key, m.crop, m.y, m.fold, """ + ", ".join(f"{_z(c)} AS z{i}" for i, c in enumerate(FEATS)) + """
       FROM mf m, st WHERE m.part = 'train'),
dl AS (SELECT greatest(0.01 * stddev_pop(y), 1e-6) AS delta FROM tr),
top AS (SELECT z0, z1, z2, z3, z4, md5('42|' || """ + _ROW_KEY + f""") AS h FROM tr ORDER BY h LIMIT {4 * EVAL_LANDMARKS}),
lm AS (SELECT z0, z1, z2, z3, z4, row_number() OVER (ORDER BY min(h)) - 1 AS k FROM top GROUP BY z0, z1, z2, z3, z4
       QUALIFY row_number() OVER (ORDER BY min(h)) <= {EVAL_LANDMARKS})"""


def _kernel_sql(k, gamma):
    near = " + ".join(f"(tr.z{i} - (SELECT z{i} FROM lm WHERE k = {k})) * (tr.z{i} - (SELECT z{i} FROM lm WHERE k = {k}))" for i in range(len(FEATS)))
    return f"exp(-{gamma} * ({near}))"


def _terms_sql(name):
    if name == "Linear":
        return [f"z{i}" for i in range(len(FEATS))]
    if name == "RBF":
        return [_kernel_sql(k, 0.2) for k in range(EVAL_LANDMARKS)]
    fmap = poly_map(len(FEATS), 3, None, 1.0)
    return [" * ".join([repr(float(c)), *(f"z{i}" for i, n in enumerate(e) for _ in range(int(n)))]) for e, c in zip(fmap.exps, fmap.coefs)]


def _eval_sql(name):
    terms, k = _terms_sql(name), KERNELS[name]
    ws = [fixed_weight(i) for i in range(len(terms))]
    norm = 0.5 * sum(w * w for w in ws)
    fit = " + ".join([repr(FIXED_B), *(f"p{i} * {w}" for i, w in enumerate(ws))])
    rows = [f"SELECT CAST({i} AS BIGINT) AS term, ({w} - {k['C']} * sum(dl * p{i})) / count(*) AS gradient FROM ls" for i, w in enumerate(ws)]
    rows.append(f"SELECT CAST(-1 AS BIGINT), -{k['C']} * sum(dl) / count(*) FROM ls")
    return _TRAIN_SQL + f""",
ph AS (SELECT y, {', '.join(f'{t} AS p{i}' for i, t in enumerate(terms))} FROM tr),
rs AS (SELECT *, y - ({fit}) AS r FROM ph),
ls AS (SELECT *, CASE WHEN abs(r) - {k['eps']} <= delta THEN greatest(abs(r) - {k['eps']}, 0) * greatest(abs(r) - {k['eps']}, 0) / (2 * delta)
                      ELSE abs(r) - {k['eps']} - delta / 2 END AS loss,
              sign(r) * least(greatest(abs(r) - {k['eps']}, 0) / delta, 1) AS dl FROM rs, dl),
ob AS (SELECT ({norm} + {k['C']} * sum(loss)) / count(*) AS objective FROM ls),
gr AS ({' UNION ALL '.join(rows)})
SELECT term, round_even(gradient * 1e6, 0) / 1e6 AS gradient, round_even(objective * 1e6, 0) / 1e6 AS objective FROM gr, ob"""


def _evaluation(name):
    def q(spark, d):
        z = zframe(spark, d)
        train = z.where(F.col("part") == "train")
        k, fmap = KERNELS[name], _eval_map(name, train)
        w = np.array([[fixed_weight(i)] for i in range(fmap.dim_out)])
        obj, gw, gb = evaluate(train.select(*FEATS, "y"), FEATS, "y", fmap, w, np.array([FIXED_B]), [k["C"]], [k["eps"]])
        rows = [(i, float(g), float(obj[0])) for i, g in enumerate(gw[:, 0])] + [(-1, float(gb[0]), float(obj[0]))]
        return spark.createDataFrame(rows, "term bigint, gradient double, objective double") \
            .select("term", round_half_even("gradient", 6).alias("gradient"), round_half_even("objective", 6).alias("objective"))
    q.__doc__ = f"M1-M3: loss and gradient of the {name} regressor at fixed weights over the train part."
    return q


for _q, _n in [("svr_eval_linear", "Linear"), ("svr_eval_poly", "Polynomial"), ("svr_eval_rbf", "RBF")]:
    register(_q, _eval_sql(_n))(_evaluation(_n))


def _scale(c, e):
    return c / (c + 10.0 * e)


def fixed_grid(spark, d):
    """(C, gamma, eps, fold, objective, test_rmse, train_rmse): the 27 x 3 grid at fixed weights, scaled by C / (C + 10 eps)."""
    z = zframe(spark, d)
    train = z.where(F.col("part") == "train")
    marks = pick_landmarks(train, FEATS, EVAL_LANDMARKS, 42, row_key_cols())
    data = train.select(*FEATS, "y", F.col("fold").cast("int").alias("fold"))
    settings = [(c, e, f) for c in GRID_C for e in GRID_EPS for f in range(3)]
    cs, es, fs = (np.array(x) for x in zip(*settings))
    base = np.array([fixed_weight(i) for i in range(len(marks))])
    w = base[:, None] * np.array([_scale(c, e) for c, e, _ in settings])[None, :]
    rows = []
    for g in GRID_GAMMA:
        fit = SVRFit(landmark_map(marks, g), w, np.full(len(settings), FIXED_B), cs, es, fs)
        obj, _, _ = evaluate(data, FEATS, "y", fit.fmap, w, fit.b, cs, es, "fold", fs)
        for (c, e, f), o, (te, tr) in zip(settings, obj, fold_scores(data, FEATS, "y", "fold", fit)):
            rows.append((c, g, e, f, float(o), float(te), float(tr)))
    return spark.createDataFrame(rows, "C double, gamma double, eps double, fold int, objective double, test_rmse double, train_rmse double")


def _grid_sql():
    lin = {g: " + ".join(f"{fixed_weight(k)} * {_kernel_sql(k, g)}" for k in range(EVAL_LANDMARKS)) for g in GRID_GAMMA}
    kk = " UNION ALL ".join(f"SELECT CAST({g} AS DOUBLE) AS gamma, y, fold, {t} AS lin FROM tr" for g, t in lin.items())
    st = " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS C, CAST({e} AS DOUBLE) AS eps, CAST({_scale(c, e)!r} AS DOUBLE) AS s, {f} AS f"
                            for c in GRID_C for e in GRID_EPS for f in range(3))
    norm = 0.5 * sum(fixed_weight(k) ** 2 for k in range(EVAL_LANDMARKS))
    return _TRAIN_SQL + f""",
kk AS ({kk}), sg AS ({st}),
rs AS (SELECT C, gamma, eps, s, f, fold, y - ({FIXED_B} + s * lin) AS r, delta FROM kk, sg, dl),
gr AS (SELECT C, gamma, eps, f AS fold,
  (any_value(s) * any_value(s) * {norm} + C * sum(CASE WHEN abs(r) - eps <= delta THEN greatest(abs(r) - eps, 0) * greatest(abs(r) - eps, 0) / (2 * delta)
     ELSE abs(r) - eps - delta / 2 END) FILTER (fold <> f)) / count(*) FILTER (fold <> f) AS objective,
  sqrt(avg(r * r) FILTER (fold = f)) AS test_rmse, sqrt(avg(r * r) FILTER (fold <> f)) AS train_rmse
  FROM rs GROUP BY C, gamma, eps, f)
"""


def staged_grid(spark, d):
    return ST.stage(spark, d, "fixed_grid", lambda: fixed_grid(spark, d))


@register("grid_eval", _grid_sql() + """SELECT C, gamma, eps, CAST(fold AS BIGINT) AS fold, round_even(objective * 1e6, 0) / 1e6 AS objective,
  round_even(test_rmse * 1e6, 0) / 1e6 AS test_rmse, round_even(train_rmse * 1e6, 0) / 1e6 AS train_rmse FROM gr""")
def grid_eval(spark, d):
    """M5: objective, held-out and train RMSE of every setting and fold of the grid at fixed weights."""
    g = staged_grid(spark, d)
    return g.select("C", "gamma", "eps", "fold", *[round_half_even(c, 6).alias(c) for c in ("objective", "test_rmse", "train_rmse")])


@register("cv_pivot", _grid_sql() + "SELECT eps, C, " + ", ".join(
    f"round_even(avg(CASE WHEN gamma = {g} THEN test_rmse END) * 1e4, 0) / 1e4 AS gamma_{i}" for i, g in enumerate(sorted(GRID_GAMMA)))
    + " FROM gr GROUP BY eps, C")
def cv_pivot(spark, d):
    """Mean held-out score, C x gamma, per epsilon slice (heatmap table)."""
    return M.cv_pivot(staged_grid(spark, d), score="test_rmse")


@register("cv_range", _grid_sql() + """
SELECT round_even(min(s) * 1e4, 0) / 1e4 AS min_score, round_even(max(s) * 1e4, 0) / 1e4 AS max_score,
       arg_min(C, (s, C, gamma, eps)) AS best_C, arg_min(gamma, (s, C, gamma, eps)) AS best_gamma,
       arg_min(eps, (s, C, gamma, eps)) AS best_eps
FROM (SELECT C, gamma, eps, avg(test_rmse) AS s FROM gr GROUP BY C, gamma, eps)""")
def cv_range(spark, d):
    """Smallest and largest mean held-out score and the best setting."""
    return M.grid_range(staged_grid(spark, d), score="test_rmse")


@register("cv_pivot_fitted")
def cv_pivot_fitted(spark, d):
    """M8: the same heatmap table over the fitted grid search."""
    return M.cv_pivot(staged_cv(spark, d), score="test_rmse")


# ---- fitted models, stored and held to account ------------------------------------

def model_path(spark, name):
    """Where this application's fitted model ``name`` is stored."""
    return f"{checkpoint_dir(spark).rstrip('/')}/agrolith-models/{spark.sparkContext.applicationId}/{name}"


def _stored(spark, name, part):
    return f"read_parquet('{model_path(spark, name).removeprefix('file:')}/{part}/*.parquet')"


def _gap_sql(spark):
    """Primal, dual and gap of the stored models, from their weights and the train rows."""
    ctes, out = [], []
    for name, k in KERNELS.items():
        t, n = name.lower(), len(FEATS)
        if k["kind"] == "rbf":
            near = " + ".join(f"(tr.z{i} - l.x[{i + 1}]) * (tr.z{i} - l.x[{i + 1}])" for i in range(n))
            ctes.append(f"""{t}_k AS (SELECT tr.rid, l.k, exp(-l.gamma * ({near})) AS v FROM tr, {_stored(spark, t, 'landmarks')} l),
{t}_b AS (SELECT p.k, sum(p.value * w.weight) AS beta FROM {_stored(spark, t, 'projection')} p JOIN {_stored(spark, t, 'weights')} w ON p.idx = w.idx GROUP BY p.k),
{t}_f AS (SELECT rid, sum(v * beta) AS f FROM {t}_k JOIN {t}_b USING (k) GROUP BY rid),
""")
            v2 = f"""(SELECT sum(c * c) FROM (SELECT p.idx, sum(p.value * m.s) AS c FROM {_stored(spark, t, 'projection')} p
      JOIN (SELECT k, sum(a * v) AS s FROM {t}_a JOIN {t}_k USING (rid) GROUP BY k) m ON p.k = m.k GROUP BY p.idx))"""
        else:
            fmap = poly_map(n, 3, None, 1.0)
            terms = [f"z{i}" for i in range(n)] if k["kind"] == "linear" else \
                [" * ".join([repr(float(c)), *(f"z{i}" for i, e in enumerate(x) for _ in range(int(e)))]) for x, c in zip(fmap.exps, fmap.coefs)]
            ctes.append(f"""{t}_w AS (SELECT list(weight ORDER BY idx) AS w FROM {_stored(spark, t, 'weights')} WHERE idx >= 0),
{t}_f AS (SELECT rid, {' + '.join(f'({x}) * w[{i + 1}]' for i, x in enumerate(terms))} AS f FROM tr, {t}_w),
""")
            v2 = "(SELECT " + " + ".join(f"sum(a * ({x})) * sum(a * ({x}))" for x in terms) + f" FROM {t}_a JOIN tr USING (rid))"
        over = f"greatest(abs(r) - {k['eps']}, 0)"
        ctes[-1] += f"""{t}_r AS (SELECT rid, y, y - f - (SELECT weight FROM {_stored(spark, t, 'weights')} WHERE idx < 0) AS r FROM tr JOIN {t}_f USING (rid)),
{t}_l AS (SELECT rid, y, delta, CASE WHEN {over} <= delta THEN {over} * {over} / (2 * delta) ELSE {over} - delta / 2 END AS loss,
                 {k['C']} * sign(r) * least({over} / delta, 1) AS a FROM {t}_r, dl),
{t}_s AS (SELECT sum(greatest(a, 0)) AS up, sum(greatest(-a, 0)) AS down FROM {t}_l),
{t}_a AS (SELECT rid, y, delta, loss, a * CASE WHEN a > 0 THEN least(up, down) / up WHEN a < 0 THEN least(up, down) / down ELSE 0 END AS a FROM {t}_l, {t}_s),
{t}_o AS (SELECT count(*) AS n, 0.5 * (SELECT sum(weight * weight) FROM {_stored(spark, t, 'weights')} WHERE idx >= 0) + {k['C']} * sum(loss) AS primal,
                 sum(a * y) - {k['eps']} * sum(abs(a)) - 0.5 * any_value(delta) / {k['C']} * sum(a * a) - 0.5 * {v2} AS dual FROM {t}_a)"""
        out.append(f"SELECT '{name}' AS model, n, primal / n AS primal, dual / n AS dual, (primal - dual) / abs(primal) AS gap FROM {t}_o")
    return _TRAIN_SQL.replace("tr AS (SELECT", "tr AS (SELECT row_number() OVER () AS rid,") + ",\n" + ",\n".join(ctes) + f"""
SELECT model, CAST(n AS BIGINT) AS n, round_even(primal * 1e6, 0) / 1e6 AS primal, round_even(dual * 1e6, 0) / 1e6 AS dual,
       round_even(gap * 1e7, 0) / 1e7 AS gap, gap < 1e-3 AS converged FROM ({' UNION ALL '.join(out)})"""


_STORED: dict[str, str] = {}


def _store(spark, d, name, cache=None):
    """The default kernel ``name`` fitted on the train part, stored as tables (once per input) and read back."""
    path = model_path(spark, name.lower())
    tag = ST.signature(spark, d)
    if _STORED.get(path) != tag:
        mf = ST.model_frame(spark, d)
        scaler = fixed_scaler(mf)
        train = scaler.transform(mf).where(F.col("part") == "train")
        save_model(spark, path, scaler, ST.dictionary(spark, d), _fit(train, name, cache), FEATS)
        _STORED[path] = tag
    return load_model(spark, path)


@register("svr_gap", later=_gap_sql)
def svr_gap(spark, d):
    """Per default kernel the primal and dual objective per train row of the fitted, stored and reloaded model, and their gap.

    The gap bounds how far the fit is from the optimum; ``converged``: below a thousandth of the objective.
    """
    z = zframe(spark, d)
    train = z.where(F.col("part") == "train")
    cache = training_blocks(train, FEATS, "y")
    rows, n = [], cache.count()
    for name in KERNELS:
        (primal,), (dual,) = duality_gap(cache, FEATS, "y", _store(spark, d, name, cache)["fit"])
        rows.append((name, n, float(primal), float(dual), float((primal - dual) / abs(primal))))
    cache.unpersist()
    out = spark.createDataFrame(rows, "model string, n bigint, primal double, dual double, gap double")
    return out.select("model", "n", round_half_even("primal", 6).alias("primal"), round_half_even("dual", 6).alias("dual"),
                      round_half_even("gap", 7).alias("gap"), (F.col("gap") < 1e-3).alias("converged"))


def _stored_score_cte(spark, name, rows, out):
    """CTE ``out`` (rid, pred): the stored model ``name`` applied to the standardised columns z0.. of ``rows``."""
    t, n = name.lower(), len(FEATS)
    b = f"(SELECT weight FROM {_stored(spark, t, 'weights')} WHERE idx < 0)"
    if KERNELS[name]["kind"] == "rbf":
        near = " + ".join(f"(z{i} - l.x[{i + 1}]) * (z{i} - l.x[{i + 1}])" for i in range(n))
        return f"""{out}_b AS (SELECT p.k, sum(p.value * w.weight) AS beta FROM {_stored(spark, t, 'projection')} p JOIN {_stored(spark, t, 'weights')} w ON p.idx = w.idx GROUP BY p.k),
{out} AS (SELECT rid, sum(beta * exp(-l.gamma * ({near}))) + {b} AS pred FROM {rows}, {_stored(spark, t, 'landmarks')} l JOIN {out}_b s ON s.k = l.k GROUP BY rid)"""
    fmap = poly_map(n, 3, None, 1.0)
    terms = [f"z{i}" for i in range(n)] if name == "Linear" else \
        [" * ".join([repr(float(c)), *(f"z{i}" for i, e in enumerate(x) for _ in range(int(e)))]) for x, c in zip(fmap.exps, fmap.coefs)]
    return f"""{out}_w AS (SELECT list(weight ORDER BY idx) AS w FROM {_stored(spark, t, 'weights')} WHERE idx >= 0),
{out} AS (SELECT rid, {' + '.join(f'({x}) * w[{i + 1}]' for i, x in enumerate(terms))} + {b} AS pred FROM {rows}, {out}_w)"""


_TEST_SQL = MF + SQL_PRED.split(",\nlp AS")[0] + f""",
ts AS (SELECT row_number() OVER () AS rid, m.order_key, m.crop, m.y, {', '.join(f'{_z(c)} AS z{i}' for i, c in enumerate(FEATS))}
       FROM mf m, st WHERE m.part = 'test')"""


def _stored_score_sql(spark):
    return _TEST_SQL + ",\n" + _stored_score_cte(spark, "RBF", "ts", "sc") + """
SELECT order_key, crop, y, round_even(pred * 1e4, 0) / 1e4 AS pred FROM ts JOIN sc USING (rid)"""


def _stored_predict(spark, d, name):
    """A scorer of unscaled rows with the stored model ``name``, all in the JVM; the features stay as they are."""
    m = _store(spark, d, name)

    def apply(df):
        raw = df.withColumns({f"_raw_{c}": F.col(c) for c in m["features"]})
        out = predict(m["scaler"].transform(raw), m["features"], m["fit"])
        return out.withColumns({c: F.col(f"_raw_{c}") for c in m["features"]}).drop(*[f"_raw_{c}" for c in m["features"]])
    return apply


def _test_rows(spark, d):
    return ST.model_frame(spark, d).where(F.col("part") == "test").select("order_key", "crop", "y", *FEATS)


@register("score_stored_model", later=_stored_score_sql)
def score_stored_model(spark, d):
    """The RBF regressor fitted, stored as tables, read back, and used to score the test rows in the JVM."""
    out = _stored_predict(spark, d, "RBF")(_test_rows(spark, d))
    return out.select("order_key", "crop", "y", round_half_even("pred", 4).alias("pred"))


def _report_sql(spark):
    ctes = ",\n".join(_stored_score_cte(spark, name, "ts", f"s{i}") for i, name in enumerate(KERNELS))
    preds = " UNION ALL ".join(f"SELECT '{name}' AS model, y, pred FROM ts JOIN s{i} USING (rid)" for i, name in enumerate(KERNELS))
    return _TEST_SQL + f""",
{ctes},
lp AS ({preds}),""" + METRICS_SQL + "\nSELECT *, CAST(row_number() OVER (ORDER BY rmse, model) AS BIGINT) AS rank FROM mt"


@register("fitted_report", later=_report_sql)
def fitted_report(spark, d):
    """The fitted, stored kernels scored on the same test rows, with errors and rank."""
    rows, out = _test_rows(spark, d), None
    for name in KERNELS:
        p = _stored_predict(spark, d, name)(rows).select(F.lit(name).alias("model"), "y", "pred")
        out = p if out is None else out.unionByName(p)
    return M.rank_models(M.regression_metrics(out))


def _fitted_importance_sql(spark):
    z = lambda src, f: ", ".join(f"({'m.p_' + c if c == f else 'm.' + c} - st.a_{c}) / st.b_{c} AS z{i}" for i, c in enumerate(FEATS))
    shown = [f"SELECT m.rank * 100 + {r * len(FEATS) + i} AS rid, '{f}' AS feature, {r} AS repeat, m.y, {z('m', f)} FROM j{r} m, st"
             for r in range(5) for i, f in enumerate(FEATS)]
    return MF + SQL_PRED.split(",\nlp AS")[0] + perm_mates_sql() + f""",
own AS (SELECT m.rank AS rid, m.y, {z('m', None)} FROM rk m, st),
var AS ({' UNION ALL '.join(shown)}),
{_stored_score_cte(spark, 'RBF', 'own', 'so')},
{_stored_score_cte(spark, 'RBF', 'var', 'sv')},
rb AS (SELECT 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2_base FROM own JOIN so USING (rid)),
rp AS (SELECT feature, repeat, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM var JOIN sv USING (rid) GROUP BY feature, repeat)
SELECT feature, CAST(repeat AS BIGINT) AS repeat, round_even((r2_base - r2) * 1e4, 0) / 1e4 AS importance FROM rp, rb"""


@register("fitted_importance", later=_fitted_importance_sql)
def fitted_importance(spark, d):
    """M13 over the fitted pipeline: R^2 drop of the stored RBF model when one feature is permuted over the whole test part."""
    mf, test = perm_frame(spark, d)
    return permutation_importance(test, FEATS, _stored_predict(spark, d, "RBF"), "y", ["order_key", "crop", "y_key"], repeats=5)


# ---- vector classifier (image stand-in) ----------------------------------------

def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = TB.table(spark, d, "embeddings")
    e = hash_split(e, "vec_id", 42).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return e


def _train_classifier(spark, d):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    e = _vectors(spark, d)
    clf = MultilayerPerceptronClassifier(layers=[64, 32, 10], maxIter=100, seed=42, labelCol="label",
                                         featuresCol="features", stepSize=0.03)
    return e, clf.fit(e.where(F.col("part") == "train"))


def class_probabilities(spark, d):
    """(vec_id, label, part, prediction, prob) of the classifier, trained once per input."""
    def build():
        from pyspark.ml.functions import vector_to_array
        e, model = _train_classifier(spark, d)
        return model.transform(e).select("vec_id", "label", "part", "prediction", vector_to_array("probability").alias("prob"))
    return ST.stage(spark, d, "class_probabilities", build)


@register("embedding_classifier")
def embedding_classifier(spark, d):
    """Multilayer classifier on the vectors; loss and accuracy % per part."""
    p = class_probabilities(spark, d)
    pl = F.element_at("prob", (F.col("label") + 1).cast("int"))
    return p.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_even(F.avg(-F.log(F.greatest(pl, F.lit(1e-12)))), 4).alias("loss"),
        round_half_even(F.avg((F.col("prediction") == F.col("label")).cast("double")) * 100, 2).alias("accuracy"))


@register("class_yield_proxy")
def class_yield_proxy(spark, d):
    """P(class 0) x 60 per vector from the trained classifier, 4 places; failures -> 0.0."""
    p = class_probabilities(spark, d)
    return p.select("vec_id", F.coalesce(round_half_even(F.element_at("prob", 1) * 60.0, 4), F.lit(0.0)).alias("yield_proxy"))


def fixed_network() -> TwoLayer:
    """The classifier's shape (64, 32, 10) with fixed weights: small binary fractions by place."""
    i, j, c = np.arange(64)[:, None], np.arange(32), np.arange(10)
    return TwoLayer(((i * 5 + j * 3) % 13 - 6) / 32, (j % 5 - 2) / 8, ((j[:, None] * 7 + c * 2) % 11 - 5) / 8, (c % 3 - 1) / 4)


@register("class_net_eval", """
WITH e AS (SELECT row_number() OVER () AS rid, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label FROM embeddings
           WHERE len(embedding) = 64 AND label BETWEEN 0 AND 9 AND len(list_filter(embedding, lambda v: v IS NULL)) = 0),
h AS (SELECT rid, x, label, list_transform(range(0, 32), lambda j: 1 / (1 + exp(-((j % 5 - 2) / 8.0
        + list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * ((i * 5 + j * 3) % 13 - 6) / 32.0)))))) AS h FROM e),
z AS (SELECT *, list_transform(range(0, 10), lambda c: (c % 3 - 1) / 4.0
        + list_sum(list_transform(range(0, 32), lambda j: h[j + 1] * ((j * 7 + c * 2) % 11 - 5) / 8.0))) AS z FROM h),
q AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) AS lse FROM z),
d AS (SELECT rid, x, h, lse - z[label + 1] AS loss, CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1 ELSE 0 END AS hit,
             list_transform(range(0, 10), lambda c: exp(z[c + 1] - lse) - CASE WHEN c = label THEN 1 ELSE 0 END) AS o FROM q),
b AS (SELECT *, list_transform(range(0, 32), lambda j: h[j + 1] * (1 - h[j + 1])
        * list_sum(list_transform(range(0, 10), lambda c: o[c + 1] * ((j * 7 + c * 2) % 11 - 5) / 8.0))) AS g FROM d),
jj AS (SELECT unnest(range(1, 33)) AS j), cc AS (SELECT unnest(range(1, 11)) AS c), ii AS (SELECT unnest(range(1, 65)) AS i),
r AS (
  SELECT 'loss' AS name, avg(loss) AS value FROM b UNION ALL SELECT 'accuracy', avg(hit) FROM b UNION ALL SELECT 'rows', count(*) FROM b
  UNION ALL SELECT 'grad_w1', sqrt(sum(m * m)) FROM (SELECT avg(x[i] * g[j]) AS m FROM b, ii, jj GROUP BY i, j)
  UNION ALL SELECT 'grad_b1', sqrt(sum(m * m)) FROM (SELECT avg(g[j]) AS m FROM b, jj GROUP BY j)
  UNION ALL SELECT 'grad_w2', sqrt(sum(m * m)) FROM (SELECT avg(h[j] * o[c]) AS m FROM b, jj, cc GROUP BY j, c)
  UNION ALL SELECT 'grad_b2', sqrt(sum(m * m)) FROM (SELECT avg(o[c]) AS m FROM b, cc GROUP BY c))
SELECT name, round_even(value * 1e6, 0) / 1e6 AS value FROM r""")
def class_net_eval(spark, d):
    """One forward and backward pass of the two-layer classifier at fixed weights: loss, accuracy and gradient norms."""
    p = network_pass(TB.table(spark, d, "embeddings"), "embedding", "label", fixed_network())
    rows = [(k, float(p[k])) for k in ("loss", "accuracy", "rows")] + [(f"grad_{k}", float(np.sqrt((p[k] ** 2).sum()))) for k in ("w1", "b1", "w2", "b2")]
    return spark.createDataFrame(rows, "name string, value double").select("name", round_half_even("value", 6).alias("value"))


@register("class_accuracy_loss", """
WITH e AS (SELECT vec_id, label, """ + fixed_logits_sql("embedding", 10) + """ AS lg FROM embeddings),
x AS (SELECT vec_id, label, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM e),
p AS (SELECT vec_id, label, list_transform(ex, lambda v: v / list_sum(ex)) AS pr FROM x),
s AS (SELECT label, list_position(pr, list_max(pr)) - 1 AS pred, -ln(pr[label + 1]) AS nll FROM p)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round_even(avg(nll) * 1e4, 0) / 1e4 AS loss,
       round_even(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) * 100 * 1e4, 0) / 1e4 AS accuracy
FROM s GROUP BY label""")
def class_accuracy_loss(spark, d):
    """Softmax over ten logits of the whole vector, arg-max class, loss and accuracy per label."""
    e = TB.table(spark, d, "embeddings")
    lg = e.select("label", fixed_logits(F.col("embedding"), 10).alias("lg"))  # a step of its own: used several times
    p = lg.select("label", softmax("lg").alias("pr"))
    s = p.select("label", argmax("pr").alias("pred"),
                 (-F.log(F.element_at("pr", (F.col("label") + 1).cast("int")))).alias("nll"))
    return s.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), round_half_even(F.avg("nll"), 4).alias("loss"),
        round_half_even(F.avg((F.col("pred") == F.col("label")).cast("double")) * 100, 4).alias("accuracy"))


__all__ = ["KERNELS", "cv_table", "zframe"]
