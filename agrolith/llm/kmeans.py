"""Exact centroid clustering with ns-bounds.

Lloyd's rounds on integer vectors. Every row keeps, for each centroid, the
squared distance it was last evaluated at and the round of that evaluation, and
the driver keeps all centroids of all rounds (k vectors a round). A stored
distance is loosened by the norm of the centroid's *total* displacement since
its evaluation, ``||c(now) - c(then)||``, which is never more than the sum of
its drifts round by round. A centroid whose loosened lower bound lies above the
row's upper bound cannot be nearest; where the test fails, the row's own
distance is made exact first, and then those of the centroids that still fail.
All comparisons that decide are between exact integers.

A round is one pass: the tasks write the rows' new state and, behind it, one row
per centroid with the sums of their part, so the next centroids come from sums
of sums. Only k sums reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import staged, with_workers

#: Rounding of square roots, as a share of the values compared.
_SLACK = 1e-11
_STATE = "vid bigint, v array<bigint>, a int, d2 array<bigint>, seen array<int>, n bigint, sums array<bigint>, evals bigint"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids: doubles while they are exact, else 64-bit integers."""
    top = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    if top * top * max(1, x.shape[1]) >= 2 ** 63:
        raise ValueError("a squared distance of these vectors does not fit a long")
    if top * top * max(1, x.shape[1]) < 2 ** 52:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def pair_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of row i of ``x`` to row i of ``c``."""
    return ((x - c) ** 2).sum(1)


def moved(history: np.ndarray) -> np.ndarray:
    """(round, centroid): how far each centroid stands from where it stood in that round."""
    d = (history[-1][None] - history).astype(np.float64)
    return np.sqrt((d * d).sum(2))


def reassign(x: np.ndarray, a: np.ndarray, d2: np.ndarray, seen: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
    """New nearest centroids (ties: smaller number); ``d2`` and ``seen`` are brought up to date in place where evaluated."""
    now, rows = len(history) - 1, np.arange(len(x))
    shift, c = moved(history), history[-1]
    off = shift[seen, np.arange(len(c))[None, :]]
    root = np.sqrt(d2.astype(np.float64))
    low = (root - off) - _SLACK * (root + off)
    own = root[rows, a] + off[rows, a]
    low[rows, a] = np.inf
    fails = np.flatnonzero((low <= (own * (1 + _SLACK))[:, None]).any(1))
    a, evals = a.copy(), len(fails)
    if len(fails):
        mine = pair_distances(x[fails], c[a[fails]])
        d2[fails, a[fails]], seen[fails, a[fails]] = mine, now
        again = low[fails] <= (np.sqrt(mine.astype(np.float64)) * (1 + _SLACK))[:, None]
        i, j = np.nonzero(again)
        d2[fails[i], j] = pair_distances(x[fails[i]], c[j])
        seen[fails[i], j] = now
        again[np.arange(len(fails)), a[fails]] = True
        exact = np.where(again, d2[fails], np.iinfo(np.int64).max)
        a[fails] = exact.argmin(1)  # the first of equal ones
        evals += len(i)
    return a, evals


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, w = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(w)), pa.array(a.ravel(), kind))


def _step(history: np.ndarray, last: bool):
    k, dim = history.shape[1:]

    def run(batches):
        count, total, evals = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        names = ["vid", "v", "a", "d2", "seen", "n", "sums", "evals"]
        for b in batches:
            if not b.num_rows:
                continue
            m = b.num_rows
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(m, dim)
            if len(history) == 1:
                d2 = distances(x, history[0])
                a, seen = d2.argmin(1), np.zeros((m, k), np.int32)
                evals += d2.size
            else:
                d2 = b.column("d2").flatten().to_numpy(zero_copy_only=False).reshape(m, k).copy()
                seen = b.column("seen").flatten().to_numpy(zero_copy_only=False).reshape(m, k).copy()
                a, e = reassign(x, b.column("a").to_numpy(zero_copy_only=False).astype(np.int64), d2, seen, history)
                evals += e
            if last:
                d2 = pair_distances(x, history[-1][a])[:, None]
                seen = np.zeros((m, 0), np.int32)
            else:
                by = np.argsort(a, kind="stable")
                at = np.searchsorted(a[by], np.arange(k))
                has = np.flatnonzero(np.diff(np.append(at, m)))
                total[has] += np.add.reduceat(x[by], at[has], axis=0)
                count += np.bincount(a, minlength=k)
            yield pa.RecordBatch.from_arrays([
                b.column("vid"), pa.nulls(m, pa.list_(pa.int64())) if last else _lists(x, pa.int64()), pa.array(a, pa.int32()), _lists(d2, pa.int64()),
                _lists(seen, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64())], names)
        # behind the rows: what this task adds to each centroid
        yield pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(np.arange(k), pa.int32()), pa.nulls(k, pa.list_(pa.int64())),
            pa.nulls(k, pa.list_(pa.int32())), pa.array(count), _lists(total, pa.int64()), pa.array([evals] + [0] * (k - 1), pa.int64())], names)
    return run


def centroids(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The next centroids from the tasks' sums; empty ones stay. k rows and k * dim sums reach the driver."""
    parts = state.where(F.col("n") > 0)
    count = {r["a"]: r["c"] for r in parts.groupBy("a").agg(F.sum("n").alias("c")).collect()}
    out = before.copy()
    for r in parts.select("a", F.posexplode("sums").alias("i", "s")).groupBy("a", "i").agg(F.sum("s").alias("s")).collect():
        out[r["a"], r["i"]] = r["s"] // count[r["a"]]  # Python's whole-number division: the exact floor
    return out


def cluster(vectors: DataFrame, id_col: str, vec_col: str, k: int, rounds: int, seed_key: Column) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(rows, final centroids, evaluations by round).

    ``vec_col`` is an array of integers, all of one length. The centroids start
    as the k vectors with the smallest ``seed_key`` (nulls last, equal keys by
    the vector); after ``rounds`` rounds the rows are assigned once more. Rows:
    id, ``cluster``, ``distance`` (squared, exact), ``cluster_inertia`` and
    ``inertia``. A repeated row counts each time; a null id is kept as it is;
    null vectors and vectors with a null component take no part; fewer than k
    vectors start as many centroids; an empty table gives no rows and no
    centroids. Vectors whose squared distances do not fit a long are an error.
    """
    spark = vectors.sparkSession
    with_workers(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vid"), F.col(vec_col).cast("array<bigint>").alias("v"), seed_key.alias("key")) \
        .where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    if not first:
        none = spark.createDataFrame([], "vid bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint")
        return none.withColumnRenamed("vid", id_col), [], []
    history = np.array([[r["v"] for r in first]], np.int64)
    state, evals = rows.select("vid", "v"), []
    for r in range(rounds + 1):
        state = staged(state.mapInArrow(_step(history, r == rounds), _STATE), "kmeans-state")
        evals.append(state.agg(F.sum("evals")).first()[0])
        if r < rounds:
            history = np.concatenate([history, centroids(state, history[-1])[None]])
            state = state.where(F.col("n").isNull()).select("vid", "v", "a", "d2", "seen")
    near = state.where(F.col("n").isNull()).select("vid", F.col("a").alias("cluster"), F.col("d2")[0].alias("distance"))
    per = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    out = near.join(F.broadcast(per.crossJoin(total)), "cluster").select("vid", "cluster", "distance", "cluster_inertia", "inertia")
    return out.withColumnRenamed("vid", id_col), history[-1].tolist(), evals
