"""Exact top-k inner-product search: ball trees per shard, branch and bound.

A bounded sample shapes the top of the tree; every vector is then routed to a
leaf, and leaves with many rows (equal vectors, say) are cut into several
shards by a hash of the id, so no shard grows with the data. Queries first
search their own shard. The k-th score they reach is shared with all other
shards: a leaf whose ball cannot hold a better score is not visited, and inside
a shard the nodes are taken in order of their upper bound q.c + |q| r and cut
by the current k-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from agrolith.llm.common import staged, with_workers

SHARD_ROWS = 8192
NODE_ROWS = 256
SAMPLE_PER_LEAF = 64
MAX_LEAVES = 4096
QUERY_BLOCK = 16384


def matrix(col) -> np.ndarray:
    """Rows of integer vectors; shorter ones are padded with zeros."""
    rows = [np.asarray(x, np.int64) for x in col]
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), max(1, width)), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while they are exact, else int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Ball:
    """A node: rows [a, b) of the tree's order, centre, radius, children."""

    __slots__ = ("a", "b", "centre", "radius", "kids")

    def __init__(self, x: np.ndarray, order: np.ndarray, a: int, b: int, leaf: int):
        pts = x[order[a:b]].astype(np.float64)
        self.a, self.b, self.kids = a, b, ()
        self.centre = pts.mean(axis=0)
        self.radius = float(np.sqrt(((pts - self.centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        if b - a <= leaf or self.radius < 1e-5:
            return
        far = pts[((pts - self.centre) ** 2).sum(axis=1).argmax()]
        other = pts[((pts - far) ** 2).sum(axis=1).argmax()]
        side = pts @ (far - other)
        by = np.argsort(side, kind="stable")
        order[a:b] = order[a:b][by]
        mid = (a + b) // 2
        self.kids = (Ball(x, order, a, mid, leaf), Ball(x, order, mid, b, leaf))


class Search:
    """Top-k of a block of queries over one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = NODE_ROWS):
        self.k = k
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by]
        self.order = np.arange(len(ids))
        self.root = Ball(self.x, self.order, 0, len(ids), leaf)

    def run(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray):
        """(scores, ids), k columns each; ``floor`` is the k-th score a query already has."""
        n = len(qid)
        self.score = np.full((n, self.k), np.iinfo(np.int64).min)
        self.found = np.full((n, self.k), np.iinfo(np.int64).max)
        self.qid, self.q, self.floor = qid, q, floor.astype(np.float64)
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.visit(self.root, np.arange(n))
        return self.score, self.found

    def bound(self, node: Ball, rows: np.ndarray) -> np.ndarray:
        return self.q[rows].astype(np.float64) @ node.centre + self.norm[rows] * node.radius

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[rows], self.score[rows, -1])

    def visit(self, node: Ball, rows: np.ndarray) -> None:
        top = self.bound(node, rows)
        rows = rows[top + 1e-3 + 1e-9 * np.abs(top) >= self.kth(rows)]
        if not len(rows):
            return
        if node.kids:
            left = float((self.bound(node.kids[0], rows) - self.bound(node.kids[1], rows)).sum()) >= 0
            for kid in node.kids if left else node.kids[::-1]:
                self.visit(kid, rows)
            return
        at = np.sort(self.order[node.a:node.b])  # by id, so that a stable sort leaves ties to the smaller id
        for a in range(0, len(at), 4 * NODE_ROWS):
            self.merge(rows, at[a:a + 4 * NODE_ROWS])

    def merge(self, rows: np.ndarray, at: np.ndarray) -> None:
        low, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        s = products(self.q[rows], self.x[at])
        s[self.qid[rows][:, None] == self.ids[at][None, :]] = low
        best = np.argsort(~s, axis=1, kind="stable")[:, : self.k]  # ~s falls as s grows, without overflow
        s = np.take_along_axis(s, best, 1)
        score = np.concatenate([self.score[rows], s], axis=1)
        found = np.concatenate([self.found[rows], np.where(s == low, none, self.ids[at][best])], axis=1)
        by = np.lexsort((found, ~score), axis=-1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, by, 1)
        self.found[rows] = np.take_along_axis(found, by, 1)


class Router:
    """The top of the tree: halving planes and the centres of the leaves, from the sample."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.width = x.shape[1]
        self.planes: list[tuple[np.ndarray, float, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.root = self._grow(x.astype(np.float64), leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(x) > 1:
            c = x.mean(axis=0)
            far = x[((x - c) ** 2).sum(axis=1).argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            side = x @ (far - other)
            cut = float(np.median(side))
            left = side < cut
            if left.any() and not left.all():
                at = len(self.planes)
                self.planes.append(())
                a = self._grow(x[left], leaves // 2)
                b = self._grow(x[~left], leaves - leaves // 2)
                self.planes[at] = (far - other, cut, a, b)
                return at
        self.centres.append(x.mean(axis=0))
        return -len(self.centres)

    def leaf(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf and its distance from the leaf's centre."""
        x = x.astype(np.float64)
        rest = (x[:, self.width:] ** 2).sum(axis=1)
        x = x[:, : self.width] if x.shape[1] > self.width else widen(x, self.width)
        at = np.full(len(x), self.root)
        while (at >= 0).any():
            for p in np.unique(at[at >= 0]):
                d, cut, a, b = self.planes[p]
                rows = np.flatnonzero(at == p)
                at[rows] = np.where(x[rows] @ d < cut, a, b)
        leaf = -at - 1
        return leaf, np.sqrt(((x - np.array(self.centres)[leaf]) ** 2).sum(axis=1) + rest)


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20, shard_rows: int = SHARD_ROWS,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): the k largest integer inner products of each query.

    ``vec_col`` is an array of integers; ``is_query`` a condition on the id that
    names the query rows. Candidates are all rows but those with the query's own
    id; ties go to the smaller id, and fewer than k candidates give them all.
    Rows with a null id, a null vector or a null component take no part; shorter
    vectors count as padded with zeros. A repeated row counts as often as it
    occurs as a candidate, and once as a query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    with_workers(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vid"), F.col(vec_col).cast("array<bigint>").alias("v")) \
        .where(F.col("vid").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = staged(rows, "topk-vectors")
    n = rows.count()
    leaves = max(1, min(MAX_LEAVES, -(-2 * n // shard_rows)))
    want = SAMPLE_PER_LEAF * leaves
    share = min(1.0, 1.5 * want / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * want).toPandas()
    router = Router(matrix(sample["v"]), leaves) if len(sample) else Router(np.zeros((1, 1)), 1)

    def route(batches):
        for p in batches:
            if len(p):
                leaf, p["dist"] = router.leaf(matrix(p["v"]))
                p["leaf"] = leaf.astype(np.int32)
                yield p[["vid", "v", "leaf", "dist"]]

    placed = staged(rows.mapInPandas(route, "vid bigint, v array<bigint>, leaf int, dist double"), "topk-leaves")
    per_leaf = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # at most MAX_LEAVES rows
    if not per_leaf:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    subs = {r["leaf"]: -(-r["n"] // shard_rows) for r in per_leaf}
    balls = {r["leaf"]: (router.centres[r["leaf"]], r["radius"] * (1 + 1e-9) + 1e-6) for r in per_leaf}
    cuts = F.broadcast(spark.createDataFrame(sorted(subs.items()), "leaf int, subs int"))
    placed = placed.join(cuts, "leaf").select("vid", "v", "leaf", F.pmod(F.xxhash64("vid", F.lit(7)), F.col("subs")).cast("int").alias("sub"))
    queries = placed.where(is_query(F.col("vid"))).dropDuplicates(["vid"]).select(F.col("vid").alias("qid"), F.col("v").alias("q"), "leaf", "sub")

    result = "qid bigint, vid bigint, score bigint"

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "vid": [], "score": []}).astype("int64")
        if not len(index) or not len(asked):
            return empty
        x, q = matrix(index["v"]), matrix(asked["q"])
        width = max(x.shape[1], q.shape[1])
        score, found = Search(index["vid"].to_numpy(np.int64), widen(x, width), k).run(
            asked["qid"].to_numpy(np.int64), widen(q, width), asked["floor"].fillna(-np.inf).to_numpy(np.float64))
        r, c = np.nonzero(found != np.iinfo(np.int64).max)
        return pd.DataFrame({"qid": asked["qid"].to_numpy(np.int64)[r], "vid": found[r, c], "score": score[r, c]})

    def over(index: DataFrame, asked: DataFrame) -> DataFrame:
        """Every (shard, block of its queries) is one bounded group.

        A shard is sent once for each ``query_block`` queries that ask it, and not
        at all if none does, so the copies are fewer than half the queries sent.
        """
        blocks = asked.groupBy("leaf", "sub").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        index = index.join(blocks, ["leaf", "sub"]).select("vid", "v", "leaf", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"))
        asked = asked.join(blocks, ["leaf", "sub"]).withColumn("qb", F.pmod(F.xxhash64("qid", F.lit(11)), F.col("blocks")).cast("int")).drop("blocks")
        keys = ["leaf", "sub", "qb"]
        index, asked = index.toDF(*index.columns), asked.toDF(*asked.columns)  # both come from one table
        return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, result)

    own = staged(over(placed, queries.withColumn("floor", F.lit(None).cast("double"))), "topk-own")
    floors = own.groupBy("qid").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("m")) \
        .select("qid", F.when(F.col("c") >= k, F.col("m")).alias("floor"))

    def spread(batches):
        """A row for each other leaf whose ball may hold a better score than the query's floor."""
        for p in batches:
            q = matrix(p["q"]).astype(np.float64)
            floor = p["floor"].fillna(-np.inf).to_numpy()
            norm = np.sqrt((q ** 2).sum(axis=1))
            for leaf, (c, r) in balls.items():
                w = max(q.shape[1], len(c))
                top = widen(q, w) @ np.pad(c, (0, w - len(c))) + norm * r
                keep = top + 1e-3 + 1e-9 * np.abs(top) >= floor
                for sub in range(subs[leaf]):
                    here = keep & ~((p["leaf"] == leaf) & (p["sub"] == sub)).to_numpy()
                    if here.any():
                        out = p.loc[here, ["qid", "q", "floor"]].copy()
                        out["leaf"], out["sub"] = np.int32(leaf), np.int32(sub)
                        yield out

    asked = queries.join(floors, "qid", "left").select("qid", "q", "floor", "leaf", "sub") \
        .mapInPandas(spread, "qid bigint, q array<bigint>, floor double, leaf int, sub int")
    rest = over(placed, asked)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vid"))
    ranked = own.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vid").alias("vec_id"), "score")
