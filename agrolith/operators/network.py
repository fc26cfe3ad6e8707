"""One pass of the two-layer vector classifier (G2): loss and gradients as sums over tasks.

Sigmoid hidden layer, softmax output, cross-entropy. Every task maps its Arrow
batches through the network as matrix products and emits one partial sum of
loss and gradients; the driver holds only the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.regress import _binary, _sum_parts
from agrolith.session import ship_package


@dataclass
class TwoLayer:
    w1: np.ndarray  # (inputs, hidden)
    b1: np.ndarray
    w2: np.ndarray  # (hidden, classes)
    b2: np.ndarray

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden values, class log-probabilities) of rows."""
        h = 1.0 / (1.0 + np.exp(-np.clip(x @ self.w1 + self.b1, -500, 500)))
        z = h @ self.w2 + self.b2
        z = z - z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))


def network_pass(df: DataFrame, vector: str, label: str, net: TwoLayer) -> dict[str, np.ndarray | float | int]:
    """Mean loss, accuracy, rows, and the mean gradients ``w1 b1 w2 b2`` at the given weights: one scan.

    Rows with a null label or vector, a vector of another length, or a label
    that is no class take no part.
    """
    ship_package(df.sparkSession)
    inputs, classes = net.w1.shape[0], net.w2.shape[1]
    shapes = {"loss": (), "right": (), "rows": (), "w1": net.w1.shape, "b1": net.b1.shape, "w2": net.w2.shape, "b2": net.b2.shape}

    def run(batches):
        total = {k: np.zeros(v) for k, v in shapes.items()}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, inputs)
            y = b.column("y").to_numpy(zero_copy_only=False)
            h, logp = net.forward(x)
            total["loss"] -= logp[np.arange(n), y].sum()
            total["right"] += (logp.argmax(1) == y).sum()
            total["rows"] += n
            out = np.exp(logp)
            out[np.arange(n), y] -= 1.0
            back = (out @ net.w2.T) * h * (1.0 - h)
            for k, g in (("w2", h.T @ out), ("b2", out.sum(0)), ("w1", x.T @ back), ("b1", back.sum(0))):
                total[k] += g
        yield _binary(np.concatenate([np.ravel(v) for v in total.values()]))

    rows = df.where((F.size(vector) == inputs) & F.col(label).between(0, classes - 1) & ~F.exists(F.col(vector), lambda v: v.isNull())) \
        .select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y"))
    flat = _sum_parts(rows, run, sum(int(np.prod(s)) for s in shapes.values()), rows.rdd.getNumPartitions())
    out, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s)
        at += n
    n = max(1.0, float(out["rows"]))
    return {"loss": float(out["loss"]) / n, "accuracy": float(out["right"]) / n, "rows": int(out["rows"]), **{k: out[k] / n for k in ("w1", "b1", "w2", "b2")}}
