"""Model store (S7): a fitted scoring pipeline as Parquet tables.

A model is: scaler statistics (one row), the label dictionary, the settings
(one JSON row), the weights (one row per (model, coefficient)) and, for an RBF
map, its landmarks (one row each) and the projection (one row per entry), all
plain tables that any engine can read. Loading gives back the same objects.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from agrolith.operators.kernel import FeatureMap
from agrolith.operators.regress import SVRFit
from agrolith.operators.scale import Scaler


def save_model(spark: SparkSession, path: str, scaler: Scaler, dictionary: DataFrame, fit: SVRFit,
               features: list[str], mode: str = "overwrite") -> None:
    path = path.rstrip("/")
    scaler.stats.write.mode(mode).parquet(f"{path}/scaler")
    dictionary.write.mode(mode).parquet(f"{path}/dictionary")
    fmap = fit.fmap.to_dict()
    marks, proj = fmap.pop("landmarks"), fmap.pop("proj")
    meta = {"method": scaler.method, "scaled": scaler.cols, "features": features, "fmap": fmap,
            "C": fit.C.tolist(), "eps": fit.eps.tolist(), "folds": fit.model_folds.tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode(mode).parquet(f"{path}/meta")
    if marks is not None:
        spark.createDataFrame([(k, fit.fmap.gamma, x) for k, x in enumerate(marks)], "k int, gamma double, x array<double>") \
            .write.mode(mode).parquet(f"{path}/landmarks")
        spark.createDataFrame([(k, i, v) for k, row in enumerate(proj) for i, v in enumerate(row)], "k int, idx int, value double") \
            .coalesce(1).write.mode(mode).parquet(f"{path}/projection")
    p, m = fit.W.shape
    rows = [(j, i, float(fit.W[i, j])) for j in range(m) for i in range(p)] + \
           [(j, -1, float(fit.b[j])) for j in range(m)]
    spark.createDataFrame(rows, "model int, idx int, weight double").write.mode(mode).parquet(f"{path}/weights")


def load_model(spark: SparkSession, path: str) -> dict:
    path = path.rstrip("/")
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    stats = spark.read.parquet(f"{path}/scaler")
    scaler = Scaler(meta["method"], meta["scaled"], stats)
    dictionary = spark.read.parquet(f"{path}/dictionary")
    marks = proj = None
    if meta["fmap"]["kind"] == "rbf":
        marks = [r["x"] for r in spark.read.parquet(f"{path}/landmarks").orderBy("k").collect()]  # rank rows
        cells = spark.read.parquet(f"{path}/projection").collect()  # rank x rank entries
        proj = np.zeros((len(marks), 1 + max((r["idx"] for r in cells), default=-1)))
        for r in cells:
            proj[r["k"], r["idx"]] = r["value"]
        proj = proj.tolist()
    fmap = FeatureMap.from_dict({**meta["fmap"], "landmarks": marks, "proj": proj})
    w = spark.read.parquet(f"{path}/weights").collect()  # feature-map size x models
    m = len(meta["C"])
    p = fmap.dim_out
    W = np.zeros((p, m))
    b = np.zeros(m)
    for r in w:
        if r.idx < 0:
            b[r.model] = r.weight
        else:
            W[r.idx, r.model] = r.weight
    fit = SVRFit(fmap, W, b, np.asarray(meta["C"]), np.asarray(meta["eps"]), np.asarray(meta["folds"]))
    return {"scaler": scaler, "dictionary": dictionary, "fit": fit, "features": meta["features"]}
