"""Explicit kernel feature maps for the regressors (M1-M3).

* linear: identity.
* polynomial ``(gamma <x, y> + coef0)^degree``: exact finite map, one weighted
  monomial per multi-index of total degree <= degree (56 terms for 5 inputs,
  degree 3); the weights are sqrt(C(d, k) coef0^(d-k) gamma^k k! / alpha!).
* RBF ``exp(-gamma |x - y|^2)``: Nystroem map (Williams & Seeger, 2001),
  phi(x) = k_m(x) V L^{-1/2}, on landmarks found by a randomly pivoted partial
  Cholesky factorisation in blocks (Chen, Epperly, Tropp & Webber, 2022): the
  distinct feature rows are drawn in proportion to what the map still misses of
  them, until the missed share of the kernel's trace is small enough.

A map is a few small numpy arrays (bounded by the map size, never by the
data) shipped to the tasks in the function closure.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.sample import sample_n
from agrolith.session import ship_package, stage_table


@dataclass
class FeatureMap:
    kind: str
    dim_in: int
    gamma: float = 0.0
    degree: int = 1
    coef0: float = 0.0
    exps: np.ndarray | None = None       # (k, d) monomial exponents
    coefs: np.ndarray | None = None      # (k,)
    landmarks: np.ndarray | None = None  # (m, d)
    proj: np.ndarray | None = None       # (m, r)
    error: float = 0.0                   # share of the kernel's trace over the rows that the map misses

    @property
    def dim_out(self) -> int:
        if self.kind == "linear":
            return self.dim_in
        if self.kind == "poly":
            return len(self.coefs)
        return self.proj.shape[1]

    def apply(self, X: np.ndarray) -> np.ndarray:
        X = np.asarray(X, dtype=np.float64)
        if self.kind == "linear":
            return X
        if self.kind == "poly":
            out = np.ones((X.shape[0], len(self.coefs)))
            for j in range(self.dim_in):
                e = self.exps[:, j]
                if e.any():
                    out *= X[:, [j]] ** e[None, :]
            return out * self.coefs[None, :]
        sq = (X * X).sum(1)[:, None] + (self.landmarks ** 2).sum(1)[None, :] - 2.0 * X @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(sq, 0.0)) @ self.proj

    def kernel(self, A: np.ndarray, B: np.ndarray) -> np.ndarray:
        """Exact kernel, for checks."""
        if self.kind == "linear":
            return A @ B.T
        if self.kind == "poly":
            return (self.gamma * (A @ B.T) + self.coef0) ** self.degree
        sq = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * A @ B.T
        return np.exp(-self.gamma * np.maximum(sq, 0.0))

    def to_dict(self) -> dict:
        arr = lambda a: None if a is None else a.tolist()
        return {"kind": self.kind, "dim_in": self.dim_in, "gamma": self.gamma, "degree": self.degree,
                "coef0": self.coef0, "exps": arr(self.exps), "coefs": arr(self.coefs),
                "landmarks": arr(self.landmarks), "proj": arr(self.proj), "error": self.error}

    @staticmethod
    def from_dict(d: dict) -> "FeatureMap":
        arr = lambda a, t=np.float64: None if a is None else np.asarray(a, dtype=t)
        return FeatureMap(d["kind"], d["dim_in"], d["gamma"], d["degree"], d["coef0"],
                          arr(d["exps"], np.int64), arr(d["coefs"]), arr(d["landmarks"]), arr(d["proj"]), d.get("error", 0.0))


def linear_map(dim_in: int) -> FeatureMap:
    return FeatureMap("linear", dim_in)


def poly_map(dim_in: int, degree: int = 3, gamma: float | None = None, coef0: float = 1.0) -> FeatureMap:
    """Exact map of the polynomial kernel; ``gamma=None`` is the "scale" rule for unit-variance inputs."""
    g = 1.0 / dim_in if gamma is None else float(gamma)
    exps, coefs = [], []
    for k in range(degree + 1):
        for combo in itertools.combinations_with_replacement(range(dim_in), k):
            alpha = np.bincount(np.asarray(combo, dtype=np.int64), minlength=dim_in)
            multi = math.factorial(k) / np.prod([math.factorial(int(a)) for a in alpha])
            w = math.comb(degree, k) * coef0 ** (degree - k) * g ** k * multi
            exps.append(alpha)
            coefs.append(math.sqrt(w))
    return FeatureMap("poly", dim_in, g, degree, coef0, np.asarray(exps), np.asarray(coefs))


def landmark_map(landmarks: np.ndarray, gamma: float) -> FeatureMap:
    """The kernel values to the landmarks themselves, without the Nystroem projection."""
    L = np.asarray(landmarks, dtype=np.float64)
    return FeatureMap("rbf", L.shape[1], float(gamma), landmarks=L, proj=np.eye(len(L)))


def rbf_map(landmarks: np.ndarray, gamma: float, rel_floor: float = 1e-8) -> FeatureMap:
    """Nystroem map from landmark rows; tiny eigenvalues are dropped."""
    L = np.asarray(landmarks, dtype=np.float64)
    fm = FeatureMap("rbf", L.shape[1], float(gamma), landmarks=L)
    K = fm.kernel(L, L)
    vals, vecs = np.linalg.eigh(K)
    keep = vals > rel_floor * vals.max()
    fm.proj = vecs[:, keep] / np.sqrt(vals[keep])[None, :]
    return fm


def pick_landmarks(df: DataFrame, cols, m: int, seed: int = 42, key_cols=None) -> np.ndarray:
    """At most m distinct rows: the first in md5 order among the first 4 m rows of that order (a bounded ``limit``)."""
    pts = sample_n(df, key_cols or list(cols), 4 * m, seed).select(*[F.col(c).cast("double") for c in cols])
    rows = dict.fromkeys(tuple(r) for r in pts.collect())  # 4 m rows, m is a parameter; in md5 order
    return np.asarray(list(rows)[:m], dtype=np.float64)


def feature_rows(df: DataFrame, cols) -> DataFrame:
    """The distinct feature rows of ``df`` with their number (``_n``), written once: several maps may grow over them."""
    return stage_table(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n")), "feature-rows")


def grown_map(df: DataFrame | None, cols, gamma: float, tol: float, block: int = 64, max_rank: int = 4096, seed: int = 42,
              rows: DataFrame | None = None) -> FeatureMap:
    """RBF map whose rank grows until it misses at most ``tol`` of the trace of the kernel over all rows.

    The rows are grouped by their features first, so repeats weigh in the trace
    but cannot be drawn twice. A pass measures what the map misses of every
    distinct row and takes ``block`` of them, with a chance in proportion to
    rows times missed share (the smallest keys of an exponential race with
    noise from a hash of the features, so any layout draws the same). Rows that
    the others of their block already explain are left out. The driver holds
    the landmarks; ``max_rank`` of them are an error, not a cut. ``rows``: the
    ``feature_rows`` of ``df``, where they are there already.
    """
    cols = list(cols)
    rows = feature_rows(df, cols) if rows is None else rows
    ship_package(rows.sparkSession)
    fm = FeatureMap("rbf", len(cols), float(gamma), landmarks=np.zeros((0, len(cols))), proj=np.zeros((0, 0)))
    turn = 0
    while True:
        def missed(batches, fm=fm):
            import pyarrow as pa
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols])
                m = np.ones(len(x)) if not len(fm.landmarks) else np.maximum(0.0, 1.0 - (fm.apply(x) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m)], [*b.schema.names, "_missed"])

        left = rows.mapInArrow(missed, ", ".join(f"{c} double" for c in cols) + ", _n double, _missed double")
        total = left.agg(F.sum(F.col("_n") * F.col("_missed")).alias("m"), F.sum("_n").alias("n")).first()  # two numbers
        fm.error = (total["m"] or 0.0) / (total["n"] or 1.0)
        if not total["n"] or fm.error <= tol:
            return fm
        noise = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        drawn = left.where(F.col("_missed") > 1e-9).withColumn("_key", -F.log(noise) / (F.col("_n") * F.col("_missed"))) \
            .orderBy("_key", *cols).limit(block).select(*cols).collect()  # one block
        new = np.array([tuple(r) for r in drawn], dtype=np.float64).reshape(-1, len(cols))
        new = new[_pivots(fm, new)]
        if not len(new):
            return fm  # what is left lies below the precision of the map
        marks = np.concatenate([fm.landmarks, new])
        if len(marks) > max_rank:
            raise ValueError(f"more than {max_rank} landmarks for a trace error of {tol}: {fm.error:.3g} with {len(fm.landmarks)}")
        fm, turn = rbf_map(marks, gamma, rel_floor=1e-12), turn + 1


def _pivots(fm: FeatureMap, x: np.ndarray, floor: float = 1e-6) -> list[int]:
    """Rows of a block by greedy pivoted Cholesky of what the map misses of them."""
    k = fm.kernel(x, x)
    if len(fm.landmarks):
        phi = fm.apply(x)
        k = k - phi @ phi.T
    picked: list[int] = []
    diag = np.diag(k).copy()
    while len(picked) < len(x) and diag.max() > floor:
        i = int(diag.argmax())
        col = k[:, i] / np.sqrt(k[i, i])
        k = k - np.outer(col, col)
        diag = np.diag(k).copy()
        diag[[*picked, i]] = 0.0
        picked.append(i)
    return picked


def make_map(kind: str, df: DataFrame | None, cols, gamma: float | None = None, degree: int = 3,
             coef0: float = 1.0, tol: float = 0.01, seed: int = 42, rows: DataFrame | None = None) -> FeatureMap:
    """The map of a kernel. ``tol``: share of the trace that the RBF map may miss; ``rows``: see ``grown_map``."""
    d = len(cols)
    if kind == "linear":
        return linear_map(d)
    if kind == "poly":
        return poly_map(d, degree, gamma, coef0)
    if kind == "rbf":
        return grown_map(df, cols, 1.0 / d if gamma is None else float(gamma), tol, seed=seed, rows=rows)
    raise ValueError(f"unknown kernel {kind!r}")
