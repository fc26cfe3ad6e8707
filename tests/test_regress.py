import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators.kernel import grown_map, linear_map, poly_map, rbf_map
from agrolith.operators.regress import SVRFit, duality_gap, fit_svr, fold_scores, predict, training_blocks, training_cache
from agrolith.sources.store import load_model, save_model


def test_poly_map_reproduces_kernel():
    rng = np.random.default_rng(0)
    A, B = rng.normal(size=(20, 5)), rng.normal(size=(15, 5))
    fm = poly_map(5, 3, None, 1.0)
    assert fm.dim_out == 56
    assert np.max(np.abs(fm.apply(A) @ fm.apply(B).T - fm.kernel(A, B))) < 1e-10


def test_rbf_map_is_exact_on_landmarks_and_close_elsewhere():
    rng = np.random.default_rng(1)
    L = rng.normal(size=(200, 5))
    fm = rbf_map(L, 0.05)
    K = fm.kernel(L, L)
    assert np.max(np.abs(fm.apply(L) @ fm.apply(L).T - K)) < 1e-6
    X = rng.normal(size=(50, 5))
    assert np.mean(np.abs(fm.apply(X) @ fm.apply(X).T - fm.kernel(X, X))) < 1e-2


def _data(spark, n=600):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(n, 3))
    y = 1.5 * X[:, 0] - 2.0 * X[:, 1] + 0.5 * X[:, 2] ** 2 + rng.normal(scale=0.1, size=n)
    rows = [(int(i), *map(float, X[i]), float(y[i]), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double, fold int")


def _objective(df, fit, j=0, delta=None):
    pdf = df.toPandas()
    X = pdf[["a", "b", "c"]].to_numpy()
    r = pdf["y"].to_numpy() - (fit.fmap.apply(X) @ fit.W[:, j] + fit.b[j])
    e = np.maximum(np.abs(r) - fit.eps[j], 0)
    return (0.5 * (fit.W[:, j] ** 2).sum() + fit.C[j] * e.sum()) / len(pdf)


@pytest.mark.parametrize("kind", ["linear", "poly"])
def test_fit_beats_zero_and_perturbations(spark, kind):
    df = _data(spark)
    fm = linear_map(3) if kind == "linear" else poly_map(3, 3, None, 1.0)
    fit = fit_svr(df, ["a", "b", "c"], "y", fm, 1.0, 0.1)
    obj = _objective(df, fit)
    zero = SVRFit(fm, np.zeros_like(fit.W), np.zeros(1), fit.C, fit.eps, fit.model_folds)
    assert obj < _objective(df, zero)
    rng = np.random.default_rng(5)
    for _ in range(5):
        pert = SVRFit(fm, fit.W + rng.normal(scale=0.05, size=fit.W.shape), fit.b + rng.normal(scale=0.05),
                      fit.C, fit.eps, fit.model_folds)
        assert obj <= _objective(df, pert) + 1e-3
    # the JVM expression predictor agrees with the numpy map
    pdf = predict(df, ["a", "b", "c"], fit).toPandas()
    ref = fm.apply(pdf[["a", "b", "c"]].to_numpy()) @ fit.W[:, 0] + fit.b[0]
    assert np.max(np.abs(pdf["pred"].to_numpy() - ref)) < 1e-9


def test_joint_fold_models_match_separate_fits(spark):
    df = _data(spark, 300)
    fm = linear_map(3)
    joint = fit_svr(df, ["a", "b", "c"], "y", fm, [1.0, 1.0], [0.1, 0.1], fold_col="fold", model_folds=[0, 1])
    solo = fit_svr(df.where(F.col("fold") != 0), ["a", "b", "c"], "y", fm, 1.0, 0.1)
    assert np.max(np.abs(joint.W[:, 0] - solo.W[:, 0])) < 2e-2


def test_rbf_predict_and_model_store_roundtrip(spark, tmpdir_path):
    from agrolith.operators import encode as E
    from agrolith.operators import scale as SC
    df = _data(spark, 200)
    L = np.asarray([[r.a, r.b, r.c] for r in df.limit(30).collect()])
    fm = rbf_map(L, 0.3)
    fit = fit_svr(df, ["a", "b", "c"], "y", fm, 10.0, 0.1)
    p1 = predict(df, ["a", "b", "c"], fit).orderBy("k").toPandas()["pred"].to_numpy()
    sc = SC.fit(df, ["a", "b", "c"])
    dic = E.fit_encoders(spark.createDataFrame([("x",), ("y",)], "k string"), ["k"])
    save_model(spark, f"{tmpdir_path}/model", sc, dic, fit, ["a", "b", "c"])
    m = load_model(spark, f"{tmpdir_path}/model")
    p2 = predict(df, m["features"], m["fit"]).orderBy("k").toPandas()["pred"].to_numpy()
    assert np.max(np.abs(p1 - p2)) < 1e-12
    assert m["dictionary"].count() == 2 and m["scaler"].cols == ["a", "b", "c"]


FEATS = ["a", "b", "c"]


def _by_hand_gap(df, fit, j, delta):
    """Primal and dual of model j from the rows, one by one in numpy."""
    pdf = df.toPandas()
    y, phi = pdf["y"].to_numpy(), fit.fmap.apply(pdf[FEATS].to_numpy())
    r = y - phi @ fit.W[:, j] - fit.b[j]
    over = np.maximum(np.abs(r) - fit.eps[j], 0)
    primal = 0.5 * (fit.W[:, j] ** 2).sum() + fit.C[j] * np.where(over <= delta, over ** 2 / (2 * delta), over - delta / 2).sum()
    a = fit.C[j] * np.sign(r) * np.minimum(over / delta, 1)
    up, down = a[a > 0].sum(), -a[a < 0].sum()
    a = np.where(a > 0, a * min(up, down) / max(up, 1e-300), a * min(up, down) / max(down, 1e-300))
    assert abs(a.sum()) < 1e-8 * np.abs(a).sum() and (np.abs(a) <= fit.C[j] + 1e-12).all()  # a feasible dual point
    v = phi.T @ a
    return primal / len(y), (-0.5 * v @ v + a @ y - fit.eps[j] * np.abs(a).sum() - 0.5 * delta / fit.C[j] * (a * a).sum()) / len(y)


@pytest.mark.parametrize("kind", ["linear", "poly", "rbf"])
def test_fit_ends_with_a_small_duality_gap(spark, kind):
    df = _data(spark)
    fm = {"linear": lambda: linear_map(3), "poly": lambda: poly_map(3, 3, None, 1.0), "rbf": lambda: grown_map(df, FEATS, 0.2, 0.01, block=16)}[kind]()
    fit = fit_svr(df, FEATS, "y", fm, [1.0, 100.0], [0.1, 0.5], gap_tol=1e-5)
    assert (fit.gap <= 1e-5).all() and (fit.gap >= -1e-9).all() and (fit.iterations < 200).all()
    primal, dual = duality_gap(df, FEATS, "y", fit)
    for j in range(2):
        p, d = _by_hand_gap(df, fit, j, fit.delta)
        assert abs(p - primal[j]) < 1e-9 * abs(p) and abs(d - dual[j]) < 1e-6 * abs(p) and (p - d) / p <= 1.1e-5


def test_each_model_of_a_grid_has_its_own_stop_and_the_choice_is_settled(spark):
    df = _data(spark, 400)
    fm = grown_map(df, FEATS, 0.1, 0.02, block=16)
    settings = [(c, e, f) for c in (1.0, 10.0, 100.0) for e in (0.1, 1.0) for f in range(3)]
    cache = training_cache(df, FEATS, "y", "fold")
    best = []
    for tol in (1e-3, 1e-4):
        fit = fit_svr(df, FEATS, "y", fm, [s[0] for s in settings], [s[1] for s in settings], fold_col="fold",
                      model_folds=[s[2] for s in settings], cache=cache, gap_tol=tol)
        assert (fit.gap <= tol).all() and len(set(fit.iterations)) > 1
        rmse = fold_scores(cache, FEATS, "y", "fold", fit)[:, 0].reshape(-1, 3).mean(1)
        best.append(settings[3 * int(rmse.argmin())][:2])
    assert best[0] == best[1]


def test_sampled_curvature_reaches_the_same_optimum(spark, monkeypatch):
    from agrolith.operators import regress
    df = _data(spark)
    cache = training_cache(df, FEATS, "y").repartition(6).persist()
    fm = poly_map(3, 2, None, 1.0)
    whole = fit_svr(df, FEATS, "y", fm, 10.0, 0.1, cache=cache, gap_tol=1e-6)
    monkeypatch.setattr(regress, "CURVATURE_TASKS", 2)
    monkeypatch.setattr(regress, "DIRECT_BYTES", 0)  # partial sums in a tree
    part = fit_svr(df, FEATS, "y", fm, 10.0, 0.1, cache=cache, gap_tol=1e-6)
    assert part.gap[0] <= 1e-6 and abs(part.objective[0] - whole.objective[0]) < 2e-6 * whole.objective[0]


def test_map_grows_to_the_error_whatever_the_repeats_and_layout(spark):
    df = _data(spark, 300).select(*FEATS)
    hot = df.limit(3)
    for _ in range(6):
        hot = hot.unionByName(hot)
    repeated = df.unionByName(hot).repartition(7)
    for tol in (0.2, 0.02, 1e-4):
        fm = grown_map(df, FEATS, 0.5, tol, block=8)
        x = df.toPandas().to_numpy()
        assert fm.error <= tol and abs(fm.error - (1 - (fm.apply(x) ** 2).sum(1)).mean()) < 1e-9
        again = grown_map(df.repartition(5), FEATS, 0.5, tol, block=8)
        assert np.array_equal(again.landmarks, fm.landmarks)
        many = grown_map(repeated, FEATS, 0.5, tol, block=8)
        assert many.error <= tol and len({tuple(r) for r in many.landmarks}) == len(many.landmarks)
    with pytest.raises(ValueError, match="landmarks"):
        grown_map(df, FEATS, 0.5, 1e-6, block=8, max_rank=10)
    assert len(grown_map(df.limit(0), FEATS, 0.5, 0.1).landmarks) == 0
    assert len(grown_map(hot, FEATS, 0.5, 1e-6).landmarks) == 3  # three different rows, no more


def test_rbf_scores_in_the_jvm_equal_the_map(spark):
    df = _data(spark, 200)
    fm = grown_map(df, FEATS, 0.3, 0.05, block=16)
    rng = np.random.default_rng(3)
    fit = SVRFit(fm, rng.normal(size=(fm.dim_out, 1)), np.array([0.7]), np.ones(1), np.ones(1), np.full(1, -1))
    out = predict(df, FEATS, fit)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    pdf = out.toPandas()
    assert np.max(np.abs(pdf["pred"].to_numpy() - (fm.apply(pdf[FEATS].to_numpy()) @ fit.W[:, 0] + 0.7))) < 1e-9
    assert predict(spark.createDataFrame([(None, 1.0, 2.0)], "a double, b double, c double"), FEATS, fit).first()["pred"] is None


def test_runs_of_equal_features_give_the_sums_of_their_rows(monkeypatch):
    """A scan over ordered runs maps each feature row once and equals one over the rows, with folds, ties and short steps."""
    import pyarrow as pa
    from agrolith.operators import regress
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(7, 3)), [900, 60, 1, 400, 300, 50, 289], axis=0)
    fold = rng.integers(0, 3, size=2000).astype(np.int32)
    y = np.round(rng.normal(scale=3.0, size=2000) + 40.0, 1)
    order = np.lexsort((y, fold, x[:, 2], x[:, 1], x[:, 0]))
    fm = poly_map(3, 2, None, 1.0)
    mapped = []
    monkeypatch.setattr(fm, "apply", lambda a, f=fm.apply: (mapped.append(len(a)), f(a))[1])
    w, d = rng.normal(size=(fm.dim_out, 4)), rng.normal(size=(fm.dim_out, 4))
    scan = regress.Scan(fm, FEATS, "y", "fold", w, np.full(4, 39.0), np.array([0.1, 0.1, 1.0, 0.0]), np.array([0.03, 3.0, 0.5, 1e-3]),
                        np.array([0, 1, 2, -1]), d, rng.normal(size=4), 1)

    def sums(at):
        batch = pa.RecordBatch.from_arrays([*(pa.array(x[at, i]) for i in range(3)), pa.array(y[at]), pa.array(fold[at])], [*FEATS, "y", "fold"])
        return np.frombuffer(next(scan.run([batch])).column(0)[0].as_py())
    by_runs = sums(order)
    assert max(mapped) <= 21  # seven feature rows, three folds
    shuffled = sums(rng.permutation(2000))
    assert np.allclose(by_runs, shuffled, rtol=1e-9, atol=1e-8)


def _few_features(spark, n=3000):
    """Rows of 40 feature rows with folds: long and short runs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    at = np.minimum(rng.geometric(0.1, size=n) - 1, 39)
    y = x[at] @ np.array([1.5, -2.0, 0.5]) + x[at, 2] ** 2 + rng.normal(scale=0.3, size=n)
    return spark.createDataFrame([(int(i), *map(float, x[at[i]]), float(y[i]), int(i % 3)) for i in range(n)],
                                 "k long, a double, b double, c double, y double, fold int")


def test_packed_blocks_hold_every_row_once_in_bounded_pieces(monkeypatch):
    """Long runs together, the rest by a bounded number of rows, whatever the labels are."""
    import pyarrow as pa
    from agrolith.operators import regress
    monkeypatch.setattr(regress, "BLOCK_ROWS", 700)
    monkeypatch.setattr(regress, "SHORT_ROWS", 50)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(140, 3)), rng.choice([1, 2, 47, 48, 300], size=140), axis=0)
    fold = rng.integers(0, 3, size=len(x)).astype(np.int32)
    y = rng.normal(size=len(x))
    y[::97] = np.nan
    y[5] = np.inf
    order = np.lexsort((y, fold, x[:, 2], x[:, 1], x[:, 0]))
    x, fold, y = x[order], fold[order], y[order]
    rows = pa.Table.from_arrays([*(pa.array(x[:, i]) for i in range(3)), pa.array(y), pa.array(fold)], [*FEATS, "y", "fold"])
    packed = list(regress._pack(rows.to_batches(max_chunksize=100), FEATS, "y", "fold"))
    blocks = list(regress._packed_blocks(packed, 3, "fold"))
    seen = np.concatenate([np.column_stack([np.repeat(bx, n, axis=0), np.repeat(bf, n), by]) for bx, bf, n, by in blocks])
    known = np.column_stack([x, fold, y])
    key = lambda t: t[np.lexsort(t.T[::-1])]
    assert np.array_equal(key(seen), key(known), equal_nan=True)
    for _, _, n, by in blocks:
        assert len(by) <= 50 or (n >= regress.LONG_RUNS).all() and np.isfinite(by).all() and len(by) < 700 + 100
    assert len(packed) < len(x) / 40


def test_fits_on_packed_blocks_are_those_of_the_rows(spark):
    df = _few_features(spark)
    fm = grown_map(df, FEATS, 0.3, 0.05, block=8)
    settings = dict(C=[1.0, 10.0, 1.0], eps=[0.1, 0.1, 0.5], fold_col="fold", model_folds=[0, 1, 2], gap_tol=1e-4)
    rows, blocks = training_cache(df, FEATS, "y", "fold"), training_blocks(df, FEATS, "y", "fold")
    assert blocks.count() == 3000 == rows.count()
    assert blocks.data.count() < 3000 / 20  # a scan is sent blocks, not rows
    was, now = (fit_svr(df, FEATS, "y", fm, cache=c, **settings) for c in (rows, blocks))
    assert (was.iterations == now.iterations).all()
    assert np.allclose(was.W, now.W, rtol=1e-6, atol=1e-9) and np.allclose(was.b, now.b, rtol=1e-9)
    assert np.allclose(was.objective, now.objective, rtol=1e-10) and np.allclose(was.gap, now.gap, rtol=1e-5)
    assert np.allclose(fold_scores(rows, FEATS, "y", "fold", now), fold_scores(blocks, FEATS, "y", "fold", now), rtol=1e-10)
    by_hand = df.toPandas()
    r = by_hand["y"].to_numpy()[:, None] - (fm.apply(by_hand[FEATS].to_numpy()) @ now.W + now.b)
    held = by_hand["fold"].to_numpy()[:, None] == np.arange(3)
    assert np.allclose(fold_scores(blocks, FEATS, "y", "fold", now)[:, 0], [np.sqrt((r[held[:, j], j] ** 2).mean()) for j in range(3)], rtol=1e-9)
    # a fit on all rows may use blocks that keep folds apart
    whole, plain = (fit_svr(df, FEATS, "y", fm, 10.0, 0.1, cache=c) for c in (blocks, training_cache(df, FEATS, "y")))
    assert np.allclose(whole.W, plain.W, rtol=1e-6, atol=1e-9) and (whole.iterations == plain.iterations).all()
    assert np.allclose(duality_gap(blocks, FEATS, "y", whole), duality_gap(df, FEATS, "y", whole), rtol=1e-9)


def test_rbf_scores_in_the_workers_equal_those_in_the_jvm(spark):
    df = _data(spark, 200)
    fm = grown_map(df, FEATS, 0.3, 0.05, block=16)
    fit = SVRFit(fm, np.random.default_rng(3).normal(size=(fm.dim_out, 1)), np.array([0.7]), np.ones(1), np.ones(1), np.full(1, -1))
    odd = spark.createDataFrame([(-1, None, 1.0, 2.0, 0.0, 0), (-2, float("nan"), 1.0, 2.0, 0.0, 0), (-3, float("inf"), 1.0, 2.0, 0.0, 0),
                                 (-4, float("nan"), float("inf"), 2.0, 0.0, 0), (-5, 1e200, 1.0, 2.0, 0.0, 0)], df.schema)
    rows = df.unionByName(odd)
    jvm, workers = (predict(rows, FEATS, fit, in_workers=w).orderBy("k").collect() for w in (False, True))
    assert len(jvm) == len(workers) == 205
    for a, b in zip(jvm, workers):
        assert a["k"] == b["k"] and (a["pred"] is None) == (b["pred"] is None)
        assert a["pred"] is None or np.isclose(a["pred"], b["pred"], rtol=1e-9, atol=1e-9, equal_nan=True), (a, b)


def test_refit_counts_packs_and_maps_the_train_rows_once(spark, monkeypatch, tmp_path):
    """One packed cache and one map a gamma serve the grid and both fits; the comparison is that of fits made on their own."""
    from agrolith.operators import metrics
    from agrolith.plans import q_learn as Q
    rng = np.random.default_rng(10)
    f = rng.normal(size=(30, 5))
    at = rng.integers(0, 30, size=900)
    y = np.sin(f[at, 0] * 2) * 3 + f[at, 1] + rng.normal(scale=0.4, size=900) + 5
    mf = spark.createDataFrame([(*map(float, f[at[i]]), float(y[i]), "test" if i % 5 == 0 else "train", int(i % 3)) for i in range(900)],
                               ", ".join(f"{c} double" for c in Q.FEATS) + ", y double, part string, fold int").persist()
    (tmp_path / "rows.txt").write_text("own rows")
    monkeypatch.setattr(Q.ST, "model_frame", lambda spark, d: mf)
    monkeypatch.setattr(Q, "GRID_C", [1.0, 10.0])
    monkeypatch.setattr(Q, "GRID_EPS", [0.1, 0.5])
    calls = {"training_blocks": [], "make_map": [], "feature_rows": []}
    for name, seen in calls.items():
        monkeypatch.setattr(Q, name, lambda *a, _f=getattr(Q, name), _s=seen, **k: (_s.append(k.get("gamma")), _f(*a, **k))[1])
    out = {r["model"]: r for r in Q.refit_best(spark, str(tmp_path)).collect()}
    assert len(calls["training_blocks"]) == 1 and len(calls["feature_rows"]) == 1
    assert sorted(calls["make_map"]) == sorted(Q.GRID_GAMMA)
    cv = Q.staged_cv(spark, str(tmp_path)).toPandas().groupby(["C", "gamma", "eps"])["test_rmse"].mean()
    assert (out["RBF tuned"]["best_C"], out["RBF tuned"]["best_gamma"], out["RBF tuned"]["best_eps"]) == cv.idxmin()
    z = Q.zframe(spark, str(tmp_path))
    train, test = z.where("part = 'train'"), z.where("part = 'test'")
    for model, c, gamma, eps in (("RBF default", 10.0, 0.2, 0.1), ("RBF tuned", *cv.idxmin())):
        fit = fit_svr(train, Q.FEATS, "y", grown_map(train, Q.FEATS, gamma, Q.RBF_TOL), c, eps, cache=training_cache(train, Q.FEATS, "y"))
        p = predict(test, Q.FEATS, fit).select(F.lit(model).alias("model"), "y", "pred")
        m = metrics.regression_metrics(p).first()
        assert (out[model]["mae"], out[model]["rmse"], out[model]["iterations"]) == (m["mae"], m["rmse"], fit.iterations[0])


def test_smoothing_reaches_its_last_width_in_two_steps_whatever_the_last_bit():
    from agrolith.operators import regress
    widths = np.random.default_rng(11).uniform(0.5, 50.0, size=500)
    assert any(0.1 * (0.1 * w) > 0.01 * w for w in widths)  # where two scans were made at widths a last bit apart
    for w in widths:
        assert regress._narrower(w, 0.01 * w) == 0.1 * w and regress._narrower(0.1 * w, 0.01 * w) == 0.01 * w
