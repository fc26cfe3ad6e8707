import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.llm import kmeans, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, key):
    """Plain Lloyd on Python integers: [(id, cluster, distance)], centroids."""
    cs = [list(v) for _, v in sorted(((key(i), v) for i, v in rows))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(cs)):
            mine = [v for (_, v), a in zip(rows, at) if a == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], cs


@pytest.mark.parametrize("k,rounds,top", [(5, 6, 9), (16, 3, 2), (4, 5, 1 << 26)])
def test_equals_plain_lloyd(spark, k, rounds, top):
    rng = random.Random(k)
    rows = [(i, [rng.randint(-top, top) for _ in range(7)]) for i in range(400)] + [(i, [1, 2, 0, 0, 1, -1, 0]) for i in range(400, 520)]
    df = spark.createDataFrame(rows, "vid bigint, v array<bigint>").withColumn("cluster", F.lit("x")).repartition(5)
    got, cs, evals = kmeans.cluster(df, "vid", "v", k, rounds, F.md5(F.col("vid").cast("string")))
    want, wcs = brute(rows, k, rounds, lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert cs == wcs
    assert sorted((r["vid"], r["cluster"], r["distance"]) for r in got.collect()) == want
    assert evals[0] == 520 * k and len(evals) == rounds + 1


def test_bounds_spare_most_evaluations_on_grouped_vectors(spark):
    rng = np.random.default_rng(1)
    mid = rng.integers(-1000, 1000, (8, 6))
    rows = [(i, [int(t) for t in mid[i % 8] + rng.integers(-20, 20, 6)]) for i in range(800)]
    _, _, evals = kmeans.cluster(spark.createDataFrame(rows, "vid bigint, v array<bigint>"), "vid", "v", 8, 6, F.col("vid"))
    assert all(e < 0.1 * evals[0] for e in evals[3:])


def test_total_displacement_is_no_more_than_summed_drifts():
    h = np.random.default_rng(2).integers(-50, 50, (6, 3, 4))
    drift = np.sqrt(((h[1:] - h[:-1]) ** 2).sum(2))
    for r, m in enumerate(kmeans.moved(h)[:-1]):
        assert (m <= drift[r:].sum(0) + 1e-9).all()


def test_edge_cases(spark):
    kind = "id bigint, v array<bigint>, vid string, a string"
    rows = [(1, [0, 0], "", ""), (1, [0, 0], "", ""), (None, [4, 0], "", ""), (2, None, "", ""), (3, [1, None], "", ""), (4, [5, 0], "", "")]
    got, cs, _ = kmeans.cluster(spark.createDataFrame(rows, kind), "id", "v", 9, 2, F.col("id"))
    # starts: the two rows of id 1 (equal vectors: all go to the first), id 4, the null id
    assert cs == [[0, 0], [0, 0], [5, 0], [4, 0]]
    assert sorted((r["id"] or 0, r["cluster"], r["distance"], r["inertia"]) for r in got.collect()) == [(0, 3, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (4, 2, 0, 0)]
    got, cs, evals = kmeans.cluster(spark.createDataFrame([], kind), "id", "v", 3, 2, F.col("id"))
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia"] and got.count() == 0 and cs == [] and evals == []


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], [int(np.floor(64 * float(x))) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
            if r["embedding"] is not None and len(r["embedding"]) == 64 and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want, cs = brute(rows, 16, 3, lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    got = queries.op13_kmeans(spark, SF).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    per = [sum(d for _, a, d in want if a == j) for j in range(16)]
    for r in got:
        assert r["centroid_sha256"] == sha[r["cluster"]] and r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per)
