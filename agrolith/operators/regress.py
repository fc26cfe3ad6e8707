"""Epsilon-insensitive kernel regression at scale (M1-M7, M9 for kernels).

Objective per model j (C_j, eps_j), on the rows it trains on:

    f_j(w, b) = 1/2 |w|^2 + C_j * sum_i l(y_i - phi(x_i) w - b)

with the smoothed epsilon-insensitive loss l(r) = 0 for |r| <= eps,
(|r| - eps)^2 / (2 delta) up to eps + delta, |r| - eps - delta/2 beyond
(delta = a small share of std(y); it tends to the plain loss as delta -> 0).

One scan of the cached training rows evaluates many models at once (a whole
grid and its folds; a model's own fold is masked out): every task maps its rows
through the feature map (rows that share their features once: they lie together,
and where many do, sums over their ordered labels stand for the rows) and emits
one partial sum. The rows are packed once for all scans (``training_blocks``): a
scan hands the workers blocks of features, lengths and labels, not rows. The driver holds only the weights and curvatures (feature-map
size x models). Each model has its own
step, history, smoothing and stop test, and leaves the scans once it is done:

* the direction comes from the curvature of the rows inside the smoothing band,
  summed over an even share of the feature rows, or all of them where they are
  few; where it is not all, secant pairs of the model's own steps correct it;
* a scan also returns the losses at shorter steps, so a step that does not
  fall far enough costs one more scan, whatever its length;
* delta starts wide and shrinks tenfold whenever the model has settled;
* the derivatives of the loss are a dual point (scaled so that they add up to
  zero), so every scan yields the model's **duality gap**. A model is done when
  its gap is at most ``gap_tol`` of its objective.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.kernel import FeatureMap
from agrolith.session import ship_package

GAP_TOL = 1e-4
#: Partitions up to which all runs add up curvature (above, an even share of them), and bytes of partial sums that are added on the driver instead of in a tree.
CURVATURE_TASKS, DIRECT_BYTES = 64, 1 << 26
SHORTER = np.array([0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4])
MEMORY = 8
#: Rows of a partition of the training cache.
PART_ROWS = 500_000
#: Rows that are packed together; those of runs too short for running sums come in blocks of so many rows.
BLOCK_ROWS, SHORT_ROWS = 1 << 18, 1 << 13
#: Runs of a batch whose curvature is added up whole, however many tasks there are.
FEW_RUNS = 64
#: Rows a run has on average where its sums come from running sums instead of its rows.
LONG_RUNS = 48
#: Rows whose distances to the landmarks a worker holds at a time.
SCORE_ROWS = 1 << 10


@dataclass
class SVRFit:
    fmap: FeatureMap
    W: np.ndarray           # (p, M)
    b: np.ndarray           # (M,)
    C: np.ndarray
    eps: np.ndarray
    model_folds: np.ndarray  # (M,), -1 = trained on all rows
    iterations: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    objective: np.ndarray = field(default_factory=lambda: np.zeros(0))  # per training row
    gap: np.ndarray = field(default_factory=lambda: np.zeros(0))        # relative duality gap
    delta: float = 0.0

    def column(self, j: int = 0) -> "SVRFit":
        pick = lambda a: a[[j]] if len(a) else a
        return SVRFit(self.fmap, self.W[:, [j]], self.b[[j]], self.C[[j]], self.eps[[j]], self.model_folds[[j]],
                      pick(self.iterations), pick(self.objective), pick(self.gap), self.delta)


def _matrix(batch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])


def _sum_parts(df: DataFrame, fn, size: int, parts: int) -> np.ndarray:
    """Sum of the tasks' partial vectors of ``size`` doubles: on the driver while they are few, else in a tree."""
    out = df.mapInArrow(fn, "part binary")
    if parts * size * 8 <= DIRECT_BYTES:
        total = np.zeros(size)
        for r in out.collect():  # at most DIRECT_BYTES
            total += np.frombuffer(r["part"])
        return total
    add = lambda a, b: b if a is None else a if b is None else a + b
    return out.rdd.treeAggregate(None, lambda acc, r: add(acc, np.frombuffer(r["part"])), add, depth=2)


def _binary(vector: np.ndarray):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([vector.tobytes()], pa.binary())], ["part"])


def _runs(x: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
    """Where consecutive rows begin to differ in features or fold."""
    new = (x[1:] != x[:-1]).any(1)
    if fold is not None:
        new |= fold[1:] != fold[:-1]
    return np.append(0, np.flatnonzero(new) + 1)


#: A block of training rows: features and fold of every run, the runs' lengths, the labels of all their rows.
Block = tuple[np.ndarray, "np.ndarray | None", np.ndarray, np.ndarray]
_PACKED = "x binary, fold binary, n binary, y binary"


def _block(x: np.ndarray, fold: np.ndarray | None, y: np.ndarray) -> Block:
    """One block of rows as they come."""
    starts = _runs(x, fold)
    return x[starts], None if fold is None else fold[starts], np.diff(np.append(starts, len(y))), y


def _row_blocks(batches, features: Sequence[str], label: str, fold_col: str | None):
    """A block from each Arrow batch of rows."""
    for batch in batches:
        if batch.num_rows:
            fold = None if fold_col is None else batch.column(fold_col).to_numpy(zero_copy_only=False)
            yield _block(_matrix(batch, features), fold, _matrix(batch, [label])[:, 0])


def _packed_blocks(batches, dim: int, fold_col: str | None):
    """The blocks that ``_pack`` wrote."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, fold, n, y = (batch.column(c)[i].as_buffer() for c in ("x", "fold", "n", "y"))
            yield (np.frombuffer(x).reshape(-1, dim), None if fold_col is None else np.frombuffer(fold, dtype=np.int64),
                   np.frombuffer(n, dtype=np.int64), np.frombuffer(y))


def _divided(x: np.ndarray, fold: np.ndarray | None, y: np.ndarray):
    """Blocks of ordered rows: the long runs together, then the rows of the short ones (or without a finite label) by ``SHORT_ROWS``."""
    starts = _runs(x, fold)
    lengths = np.diff(np.append(starts, len(y)))
    long = (lengths >= LONG_RUNS) & np.logical_and.reduceat(np.isfinite(y), starts)
    of_long = np.repeat(long, lengths)
    if long.any():
        yield x[starts[long]], None if fold is None else fold[starts[long]], lengths[long], y[of_long]
    x, fold, y = x[~of_long], None if fold is None else fold[~of_long], y[~of_long]
    for at in range(0, len(y), SHORT_ROWS):
        cut = slice(at, at + SHORT_ROWS)
        yield _block(x[cut], None if fold is None else fold[cut], y[cut])


def _pack(batches, features: Sequence[str], label: str, fold_col: str | None):
    """Arrow batches of ordered rows -> one row of ``_PACKED`` for each block."""
    import pyarrow as pa

    def packed(held):
        x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        fold = None if fold_col is None else np.concatenate([h[1] for h in held])
        for bx, bf, n, by in _divided(x, fold, y):
            cells = (bx, np.zeros(0, np.int64) if bf is None else bf.astype(np.int64), n.astype(np.int64), by)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["x", "fold", "n", "y"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((_matrix(batch, features), None if fold_col is None else batch.column(fold_col).to_numpy(zero_copy_only=False),
                         _matrix(batch, [label])[:, 0]))
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from packed(held)
            held, rows = [], 0
    if held:
        yield from packed(held)


@dataclass
class TrainingBlocks:
    """Training rows packed for the scans, persisted: a row of ``data`` is a block (features, fold, length of its runs; labels in order)."""

    data: DataFrame
    features: list[str]
    label: str
    fold_col: str | None
    rows: int
    mean: float | None
    std: float | None
    parts: int

    def count(self) -> int:
        return self.rows

    def unpersist(self) -> None:
        self.data.unpersist()

    def total(self, blocks_fn, fold_col: str | None, size: int) -> np.ndarray:
        """Sum of ``blocks_fn(blocks)`` over the tasks; a task takes the blocks of several partitions, so there is one partial sum a core."""
        tasks, dim = min(self.parts, self.data.sparkSession.sparkContext.defaultParallelism), len(self.features)
        return _sum_parts(self.data.coalesce(tasks), lambda batches: blocks_fn(_packed_blocks(batches, dim, fold_col)), size, tasks)


@dataclass
class _Ordered:
    """Runs of rows with their labels in ascending order: sums over any stretch of a run's labels (centred) from running sums."""

    starts: np.ndarray
    ends: np.ndarray
    mean: np.ndarray
    key: np.ndarray     # run * width + centred label: ascending over all runs
    width: float
    reach: float
    sum1: np.ndarray
    sum2: np.ndarray

    @staticmethod
    def of(y: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> "_Ordered | None":
        """None where the labels are not in order, or not finite."""
        falls = np.diff(y) < 0
        falls[starts[1:] - 1] = False
        if falls.any() or not np.isfinite(y).all():
            return None
        mean = np.add.reduceat(y, starts) / lengths
        c = y - np.repeat(mean, lengths)
        reach = 1.0 + 2.0 * np.abs(c).max()
        width = 2.0 * reach
        key = np.repeat(np.arange(len(starts)) * width, lengths) + c
        run = lambda v: np.append(0.0, np.cumsum(v))
        return _Ordered(starts, starts + lengths, mean, key, width, reach, run(c), run(c * c))

    def place(self, at: np.ndarray, above: bool) -> np.ndarray:
        """Per run and model the first row whose centred label is above ``at`` (or not below it)."""
        t = np.clip(at, -self.reach, self.reach) + (np.arange(len(self.mean)) * self.width)[:, None]
        return np.clip(np.searchsorted(self.key, t, side="right" if above else "left"), self.starts[:, None], self.ends[:, None])

    def sums(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (b - a).astype(np.float64), self.sum1[b] - self.sum1[a], self.sum2[b] - self.sum2[a]


@dataclass
class Scan:
    """What one scan evaluates: models at (W, b) and, for trial steps, shorter ones along (D, db)."""

    fmap: FeatureMap
    features: list[str]
    label: str
    fold_col: str | None
    W: np.ndarray
    b: np.ndarray
    eps: np.ndarray
    delta: np.ndarray
    folds: np.ndarray
    D: np.ndarray | None = None
    db: np.ndarray | None = None
    curvature_every: int = 0  # 0: none; k: every k-th run of a batch, or all where they are few

    @property
    def sizes(self) -> dict[str, tuple[int, ...]]:
        p, m = self.W.shape
        out = {"loss": (m,), "n": (m,), "vp": (p, m), "vm": (p, m), **{k: (m,) for k in ("ap", "am", "yp", "ym", "qp", "qm")}}
        if self.D is not None:
            out["shorter"] = (len(SHORTER), m)
        if self.curvature_every:
            out |= {"rows": (1,), "band_rows": (1,), "band": (m, p + 1, p + 1)}
        return out

    def run(self, batches):
        """The scan of a task's Arrow batches of rows."""
        yield from self.run_blocks(_row_blocks(batches, self.features, self.label, self.fold_col))

    def run_blocks(self, blocks):
        from pyspark import TaskContext
        total = {k: np.zeros(v) for k, v in self.sizes.items()}
        context = TaskContext.get()
        curved, turn = bool(self.curvature_every), 0 if context is None else context.partitionId()
        for x, fold, lengths, y in blocks:
            starts = np.cumsum(lengths) - lengths
            phi = self.fmap.apply(x)  # once for rows that share their features
            mask = np.ones((len(starts), len(self.b))) if fold is None else (fold[:, None] != self.folds[None, :]).astype(np.float64)
            fit, along = phi @ self.W + self.b[None, :], None if self.D is None else phi @ self.D + self.db[None, :]
            ordered = _Ordered.of(y, starts, lengths) if len(y) >= LONG_RUNS * len(starts) else None
            s = (self.by_rows(y, starts, lengths, fit, along, curved) if ordered is None else self.by_runs(ordered, fit, along, curved))
            total["loss"] += (s["loss"] * mask).sum(0)
            total["n"] += (lengths[:, None] * mask).sum(0)
            for sign in "pm":
                total["v" + sign] += phi.T @ (s["a" + sign] * mask)
                for k in "ayq":
                    total[k + sign] += (s[k + sign] * mask).sum(0)
            if along is not None:
                total["shorter"] += (s["shorter"] * mask[None, :, :]).sum(1)
            if curved:
                every = self.curvature_every if len(starts) > FEW_RUNS else 1
                pick = slice(turn % every, None, every)
                turn += 1
                total["rows"] += len(y)
                total["band_rows"] += lengths[pick].sum()
                phi1 = np.column_stack([phi[pick], np.ones(len(phi[pick]))])
                inside = (s["band"] * mask)[pick]
                for j in range(len(self.b)):
                    some = inside[:, j] > 0
                    rows = phi1[some]
                    total["band"][j] += rows.T @ (rows * inside[some, j][:, None])
        yield _binary(np.concatenate([v.ravel() for v in total.values()]))

    def by_rows(self, y, starts, lengths, fit, along, curved: bool) -> dict[str, np.ndarray]:
        """Sums of every run and model, from the rows one by one."""
        run_sum = lambda v: np.add.reduceat(v, starts, axis=0)
        r = y[:, None] - np.repeat(fit, lengths, axis=0)
        loss, dl, band = self.losses(r)
        out = {"loss": run_sum(loss)}
        for sign, d in (("p", np.maximum(dl, 0)), ("m", np.maximum(-dl, 0))):
            out |= {"a" + sign: run_sum(d), "y" + sign: run_sum(y[:, None] * d), "q" + sign: run_sum(d * d)}
        if along is not None:
            step = np.repeat(along, lengths, axis=0)
            out["shorter"] = np.stack([run_sum(self.losses(r + (1 - s) * step)[0]) for s in SHORTER])
        if curved:
            out["band"] = run_sum(band.astype(np.float64))
        return out

    def by_runs(self, o: "_Ordered", fit, along, curved: bool) -> dict[str, np.ndarray]:
        """The same sums from running sums of a run's ordered labels: the loss is a polynomial between four places."""
        k = o.mean[:, None] - fit  # a row's residual is its centred label plus k
        out = self.run_losses(o, k, True)
        if along is not None:
            out["shorter"] = np.stack([self.run_losses(o, k + (1 - s) * along, False)["loss"] for s in SHORTER])
        return out

    def run_losses(self, o: "_Ordered", k: np.ndarray, derivatives: bool) -> dict[str, np.ndarray]:
        eps, delta, mean = self.eps[None, :], self.delta[None, :], o.mean[:, None]
        first, last = o.starts[:, None], o.ends[:, None]
        out = {"loss": 0.0, "band": 0.0}
        for sign, side in (("p", 1.0), ("m", -1.0)):  # labels above and below the tube
            q = side * k - eps  # distance from the tube: side * label + q
            near, far = o.place(-side * q, side > 0), o.place(side * (delta - q), side > 0)
            band, beyond = ((near, far), (far, last)) if side > 0 else ((far, near), (first, far))
            n, s1, s2 = o.sums(*band)
            m, t1 = o.sums(*beyond)[:2]
            square = np.maximum(s2 + 2 * side * q * s1 + n * q * q, 0.0)
            out["loss"] = out["loss"] + square / (2 * delta) + side * t1 + m * (q - delta / 2)
            if derivatives:
                out["band"] = out["band"] + n
                out["a" + sign] = m + np.maximum(side * s1 + n * q, 0.0) / delta
                out["q" + sign] = m + square / (delta * delta)
                out["y" + sign] = t1 + m * mean + (side * s2 + (q + side * mean) * s1 + n * mean * q) / delta
        return out

    def losses(self, r: np.ndarray):
        """Loss, derivative by r, and whether a row lies in the smoothing band."""
        over = np.maximum(np.abs(r) - self.eps[None, :], 0.0)
        inside = over <= self.delta
        loss = np.where(inside, over * over / (2 * self.delta), over - self.delta / 2)
        return loss, np.sign(r) * np.minimum(over / self.delta, 1.0), inside & (over > 0)

    def over(self, data: "DataFrame | TrainingBlocks", parts: int) -> dict[str, np.ndarray]:
        size = sum(int(np.prod(v)) for v in self.sizes.values())
        if isinstance(data, TrainingBlocks):
            flat = data.total(self.run_blocks, self.fold_col, size)
        else:
            flat = _sum_parts(data, self.run, size, parts)
        out, at = {}, 0
        for k, v in self.sizes.items():
            n = int(np.prod(v))
            out[k] = flat[at:at + n].reshape(v)
            at += n
        return out


def objective(t: dict, W: np.ndarray, C: np.ndarray, eps: np.ndarray, delta: np.ndarray):
    """(primal, dual, gradient by w, by b) per model from the sums of a scan.

    The dual point is alpha = C * loss derivative; the larger of its positive
    and negative parts is scaled down until they add up to zero.
    """
    primal = 0.5 * (W * W).sum(0) + C * t["loss"]
    least = np.minimum(t["ap"], t["am"])
    kp = np.divide(least, t["ap"], out=np.zeros_like(least), where=t["ap"] > 0)
    km = np.divide(least, t["am"], out=np.zeros_like(least), where=t["am"] > 0)
    v = C * (kp * t["vp"] - km * t["vm"])
    dual = -0.5 * (v * v).sum(0) + C * (kp * t["yp"] - km * t["ym"]) - eps * C * (kp * t["ap"] + km * t["am"]) \
        - 0.5 * delta * C * (kp ** 2 * t["qp"] + km ** 2 * t["qm"])
    return primal, dual, W - C * (t["vp"] - t["vm"]), -C * (t["ap"] - t["am"])


def _dealt(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None) -> tuple[DataFrame, int, tuple]:
    """(rows dealt out by range and ordered, partitions, (rows, mean, standard deviation) of the label)."""
    cols = [F.col(c).cast("double").alias(c) for c in features] + [F.col(label).cast("double").alias(label)]
    if fold_col:
        cols.append(F.col(fold_col).cast("int").alias(fold_col))
    order = [*features, *([fold_col] if fold_col else []), label]
    rows = df.select(*cols)
    st = tuple(rows.agg(F.count(F.lit(1)), F.avg(label), F.stddev_pop(label)).first())  # three numbers
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-st[0] // PART_ROWS))
    # the noise comes last: rows that are alike in all need not lie in one task
    return rows.repartitionByRange(parts, *order, F.rand(7)).sortWithinPartitions(*order), parts, st


def training_cache(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None = None) -> DataFrame:
    """The rows a fit scans every iteration: features, label (and fold), persisted, in partitions of an even size.

    Rows that share their features lie together there, in order of their labels, so a scan maps them once.
    """
    return _dealt(df, features, label, fold_col)[0].persist(StorageLevel.MEMORY_AND_DISK)


def training_blocks(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None = None) -> TrainingBlocks:
    """The rows of ``training_cache``, dealt out and ordered alike, packed into blocks and persisted.

    All that a scan needs of a row but its label is kept once a run, and a block reaches a worker in one piece: a
    scan costs a few bytes a row instead of a row's way through Arrow. A fit without folds may use blocks that have them.
    """
    ship_package(df.sparkSession)
    feats = list(features)
    rows, parts, (n, mean, std) = _dealt(df, feats, label, fold_col)
    packed = rows.mapInArrow(lambda batches: _pack(batches, feats, label, fold_col), _PACKED)
    return TrainingBlocks(packed.persist(StorageLevel.MEMORY_AND_DISK), feats, label, fold_col, n, mean, std, parts)


def _narrower(delta: float, last: float) -> float:
    """The next smoothing: a tenth, or the last one, also where only the last bit of a double parts the two (a scan for nothing)."""
    return last if 0.1 * delta <= last * (1 + 1e-9) else 0.1 * delta


class _Model:
    """One model's place in its own minimisation (x = weights and intercept)."""

    def __init__(self, x: np.ndarray, delta: float):
        self.x, self.delta = x, delta
        self.f = self.g = self.h = self.d = None
        self.step, self.pairs, self.scans, self.gap, self.done = 1.0, [], 0, np.inf, False

    def point(self) -> np.ndarray:
        return self.x if self.d is None else self.x + self.step * self.d

    def accept(self, f: float, g: np.ndarray, h: np.ndarray, keep_pairs: bool) -> None:
        new = self.point()
        if keep_pairs and self.d is not None:
            s, y = new - self.x, g - self.g
            if y @ s > 1e-12 * np.sqrt((y @ y) * (s @ s)):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.x, self.f, self.g, self.h = new, f, g, h

    def aim(self) -> None:
        """Next direction: the secant pairs around the solve with the measured curvature."""
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            kept.append((a, s, y))
            q -= a * y
        d = np.linalg.solve(self.h, q)
        for a, s, y in reversed(kept):
            d += s * (a - (y @ d) / (y @ s))
        if self.g @ d <= 0:  # not a descent direction
            self.pairs, d = [], np.linalg.solve(self.h, self.g)
        self.d, self.step = -d, 1.0


def fit_svr(df: DataFrame, features: Sequence[str], label: str, fmap: FeatureMap,
            C: Sequence[float] | float = 1.0, eps: Sequence[float] | float = 0.1,
            fold_col: str | None = None, model_folds: Sequence[int] | None = None,
            max_iter: int = 5000, delta_frac: float = 0.01, cache: DataFrame | TrainingBlocks | None = None, gap_tol: float = GAP_TOL) -> SVRFit:
    """M1-M3 / M5: fit one or many epsilon-insensitive regressors on a shared feature map.

    A model ends with a relative duality gap of at most ``gap_tol``; ``gap``
    and ``iterations`` of the result say so per model. ``max_iter`` only guards
    against data that do not allow it (then the gap stays above).
    """
    C = np.atleast_1d(np.asarray(C, dtype=np.float64))
    eps = np.atleast_1d(np.asarray(eps, dtype=np.float64))
    M = max(len(C), len(eps), 1 if model_folds is None else len(model_folds))
    C, eps = np.broadcast_to(C, (M,)).copy(), np.broadcast_to(eps, (M,)).copy()
    folds = np.full(M, -1, dtype=np.int64) if model_folds is None else np.asarray(model_folds, dtype=np.int64)
    fc = fold_col if model_folds is not None else None
    ship_package(df.sparkSession)
    data = cache if cache is not None else training_blocks(df, features, label, fc)
    if isinstance(data, TrainingBlocks):
        mean, std, parts = data.mean, data.std, data.parts
    else:
        mean, std = data.agg(F.avg(label), F.stddev_pop(label)).first()  # two numbers
        parts = data.rdd.getNumPartitions()
    every, p = max(1, parts // CURVATURE_TASKS), fmap.dim_out
    last = max(delta_frac * float(std or 1.0), 1e-6)
    models = [_Model(np.append(np.zeros(p), float(mean or 0.0)), max(last, float(std or 1.0))) for _ in range(M)]
    rows_of = np.ones(M)
    for _ in range(max_iter):
        live = [j for j in range(M) if not models[j].done]
        if not live:
            break
        at = np.array([models[j].point() for j in live]).T
        along = np.array([np.zeros(p + 1) if models[j].d is None else models[j].step * models[j].d for j in live]).T
        delta = np.array([models[j].delta for j in live])
        scan = Scan(fmap, list(features), label, fc, at[:p], at[p], eps[live], delta, folds[live], along[:p], along[p], every)
        t = scan.over(data, parts)
        f, dual, gw, gb = objective(t, at[:p], C[live], eps[live], delta)
        share = float(t["rows"][0]) / max(1.0, float(t["band_rows"][0]))  # all rows for each one whose curvature was added up
        for i, j in enumerate(live):
            m = models[j]
            m.scans += 1
            rows_of[j] = max(1.0, t["n"][i])
            if m.d is not None:
                slope = m.step * (m.g @ m.d)
                if not f[i] <= m.f + 1e-4 * slope + 1e-13 * abs(m.f):
                    short = 0.5 * ((m.x[:p, None] + m.step * SHORTER[None, :] * m.d[:p, None]) ** 2).sum(0) + C[j] * t["shorter"][:, i]
                    good = np.flatnonzero(short <= m.f + 1e-4 * SHORTER * slope)
                    if len(good):
                        m.step *= SHORTER[good[short[good].argmin()]]
                        continue
                    if m.pairs:  # a poor secant model: aim again without it
                        m.pairs = []
                        m.aim()
                        continue
                    m.done = m.delta <= last  # no smaller value along a descent direction: the precision of doubles
                    m.delta, m.d = _narrower(m.delta, last), None
                    continue
            h = t["band"][i] * (C[j] / m.delta * max(1.0, share)) + np.diag(np.append(np.ones(p), 1e-9 * C[j] * rows_of[j] + 1e-12))
            m.accept(f[i], np.append(gw[:, i], gb[i]), h, share > 1)
            m.gap = (f[i] - dual[i]) / max(abs(f[i]), 1e-300)
            if m.gap <= (gap_tol if m.delta <= last else 0.03):
                if m.delta <= last:
                    m.done = True
                else:  # settled at this smoothing: the same point under a narrower one
                    m.delta, m.d, m.pairs = _narrower(m.delta, last), None, []
                continue
            m.aim()
    if cache is None:
        data.unpersist()
    x = np.array([m.x for m in models]).T
    return SVRFit(fmap, x[:p], x[p], C, eps, folds, np.array([m.scans for m in models]),
                  np.array([np.nan if m.f is None else m.f for m in models]) / rows_of, np.array([m.gap for m in models]), last)


def evaluate(df: DataFrame, features: Sequence[str], label: str, fmap: FeatureMap, W: np.ndarray, b: np.ndarray,
             C: Sequence[float], eps: Sequence[float], fold_col: str | None = None, model_folds: Sequence[int] | None = None,
             delta_frac: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objective (M,), gradient (p, M) and intercept gradient (M,) per training row of M models at the given weights: one scan."""
    t, C, eps, delta = _evaluated(df, features, label, fmap, W, b, C, eps, fold_col, model_folds, delta_frac)
    primal, _, gw, gb = objective(t, W, C, eps, delta)
    n = np.maximum(t["n"], 1.0)
    return primal / n, gw / n[None, :], gb / n


def duality_gap(df: DataFrame | TrainingBlocks, features: Sequence[str], label: str, fit: SVRFit, fold_col: str | None = None,
                delta_frac: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(primal, dual) per training row of the models of a fit: the distance to the optimum is at most their difference. One scan."""
    t, C, eps, delta = _evaluated(df, features, label, fit.fmap, fit.W, fit.b, fit.C, fit.eps, fold_col,
                                  None if fold_col is None else fit.model_folds, delta_frac)
    primal, dual, _, _ = objective(t, fit.W, C, eps, delta)
    n = np.maximum(t["n"], 1.0)
    return primal / n, dual / n


def _evaluated(df, features, label, fmap, W, b, C, eps, fold_col, model_folds, delta_frac):
    C, eps = np.asarray(C, dtype=np.float64), np.asarray(eps, dtype=np.float64)
    folds = np.full(W.shape[1], -1) if model_folds is None else np.asarray(model_folds)
    if isinstance(df, TrainingBlocks):
        s, parts = df.std, df.parts
    else:
        ship_package(df.sparkSession)
        s, parts = df.agg(F.stddev_pop(label).alias("s")).first()["s"], df.rdd.getNumPartitions()
    delta = np.full(W.shape[1], max(delta_frac * float(s or 1.0), 1e-6))
    scan = Scan(fmap, list(features), label, fold_col, W, b, eps, delta, folds)
    return scan.over(df, parts), C, eps, delta


def fold_scores(df: DataFrame | TrainingBlocks, features: Sequence[str], label: str, fold_col: str, fit: SVRFit) -> np.ndarray:
    """Per model: RMSE on its held-out fold and on its training rows -> (M, 2)."""
    fmap, W, b, folds = fit.fmap, fit.W, fit.b, fit.model_folds
    feats = list(features)

    def run(blocks):
        total = np.zeros((4, W.shape[1]))  # squares and rows, held out and not
        for x, fold, n, y in blocks:
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(y, starts) / n
            c = y - np.repeat(mean, n)  # about its run's mean
            squares = np.add.reduceat(c * c, starts)[:, None] + n[:, None] * (mean[:, None] - (fmap.apply(x) @ W + b[None, :])) ** 2
            held = (fold[:, None] == folds[None, :]).astype(np.float64)
            rows = n[:, None].astype(np.float64)
            total += np.stack([(squares * held).sum(0), (rows * held).sum(0), (squares * (1 - held)).sum(0), (rows * (1 - held)).sum(0)])
        yield _binary(total)

    if isinstance(df, TrainingBlocks):
        sums = df.total(run, fold_col, 4 * W.shape[1])
    else:
        ship_package(df.sparkSession)
        sums = _sum_parts(df, lambda batches: run(_row_blocks(batches, feats, label, fold_col)), 4 * W.shape[1], df.rdd.getNumPartitions())
    out, n_out, inside, n_in = sums.reshape(4, -1)
    return np.stack([np.sqrt(out / np.maximum(n_out, 1)), np.sqrt(inside / np.maximum(n_in, 1))], axis=1)


def predict(df: DataFrame, features: Sequence[str], fit: SVRFit, j: int = 0, out: str = "pred", in_workers: bool = False) -> DataFrame:
    """M9 for a fitted model, as JVM expressions for every kernel.

    Linear and polynomial maps are sums of terms. An RBF score is a sum over
    the landmarks, ``b + sum_k beta_k exp(-gamma |x - l_k|^2)``: landmarks and
    coefficients are one constant array that the rows fold over, so no row
    leaves the JVM and the plan does not grow with the rank. The fold is
    interpreted, a landmark at a time; ``in_workers`` sends the features to the
    Python workers instead, which take the same sum on whole Arrow batches.
    """
    fmap, w, b = fit.fmap, fit.W[:, j], float(fit.b[j])
    x = [F.col(c).cast("double") for c in features]
    if fmap.kind == "rbf" and in_workers:
        ship_package(df.sparkSession)
        return df.withColumn(out, _rbf_worker_score(fmap, fmap.proj @ w, b)(*x))
    if fmap.kind == "rbf":
        return df.withColumn(out, _rbf_score(x, fmap, fmap.proj @ w, b))
    if fmap.kind == "linear":
        terms = [c * F.lit(float(wi)) for c, wi in zip(x, w)]
    else:
        terms = []
        for e, cf, wi in zip(fmap.exps, fmap.coefs, w):
            t = F.lit(float(cf * wi))
            for c, k in zip(x, e):
                for _ in range(int(k)):
                    t = t * c
            terms.append(t)
    expr = F.lit(b)
    for t in terms:
        expr = expr + t
    return df.withColumn(out, expr)


def _rbf_score(x: list, fmap: FeatureMap, beta: np.ndarray, b: float):
    import json
    kind = "array<struct<" + ",".join(f"l{i}:double" for i in range(fmap.dim_in)) + ",beta:double>>"
    text = json.dumps([{**{f"l{i}": float(v) for i, v in enumerate(row)}, "beta": float(c)} for row, c in zip(fmap.landmarks, beta)])
    marks = F.from_json(F.lit(text), kind)  # a constant: folded once while planning

    def add(acc, m):
        near = None
        for i, c in enumerate(x):
            d = (c - m[f"l{i}"]) * (c - m[f"l{i}"])
            near = d if near is None else near + d
        return acc + m["beta"] * F.exp(F.lit(-fmap.gamma) * near)

    some_null = x[0].isNull()
    for c in x[1:]:
        some_null = some_null | c.isNull()
    return F.when(some_null, F.lit(None).cast("double")).otherwise(F.aggregate(marks, F.lit(b), add))


def _rbf_worker_score(fmap: FeatureMap, beta: np.ndarray, b: float):
    """The sum of ``_rbf_score`` as an Arrow function of the features; a row with a null feature has none."""
    import pyarrow as pa
    kernels = FeatureMap("rbf", fmap.dim_in, fmap.gamma, landmarks=fmap.landmarks, proj=beta[:, None])

    def score(*columns):
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        null = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        pred = np.concatenate([kernels.apply(x[at:at + SCORE_ROWS])[:, 0] for at in range(0, len(x), SCORE_ROWS)]) + b
        pred[np.isinf(x).any(1) & ~np.isnan(x).any(1)] = b  # infinitely far from all landmarks
        return pa.array(pred, mask=null)

    score.__annotations__ = {"columns": pa.Array, "return": pa.Array}  # Spark wants the types themselves
    return F.arrow_udf(score, "double")
