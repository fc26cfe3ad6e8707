import random

import numpy as np
import pytest

from agrolith.llm import queries, topk

SF = "/root/testdata/sf0.001"


def brute(vectors, ask, k):
    out = []
    for q, x in {i: v for i, v in vectors if ask(i)}.items():
        best = sorted(((-sum(a * b for a, b in zip(x, y)), j) for j, y in vectors if j != q))[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, query_block", [(16, 1 << 14), (16, 3), (100_000, 5)])
def test_equals_brute_force_with_ties_and_a_hot_vector(spark, shard_rows, query_block):
    rng = random.Random(3)
    vectors = [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(240)] + [(i, [1, 2, 0, 0, 1, -1]) for i in range(240, 360)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors], "vid bigint, v array<bigint>, leaf int, score int")
    got = topk.top_k(df, "vid", "v", lambda i: i % 20 == 0, k=7, shard_rows=shard_rows, query_block=query_block).collect()
    assert sorted(tuple(r) for r in got) == brute(vectors, lambda i: i % 20 == 0, 7)


def test_edge_cases(spark):
    kind = "id bigint, v array<bigint>"
    rows = [(0, [1, 2]), (20, [3]), (1, None), (2, [1, None]), (None, [1, 1]), (40, []), (3, [-1, 5])]
    got = topk.top_k(spark.createDataFrame(rows, kind), "id", "v", lambda i: i % 20 == 0, k=20).collect()
    assert sorted(tuple(r) for r in got) == sorted([
        (0, 1, 3, 9), (0, 2, 20, 3), (0, 3, 40, 0), (20, 1, 0, 3), (20, 2, 40, 0), (20, 3, 3, -3), (40, 1, 0, 0), (40, 2, 3, 0), (40, 3, 20, 0)])
    assert topk.top_k(spark.createDataFrame([], kind), "id", "v", lambda i: i % 20 == 0).count() == 0
    big = [(0, [2 ** 30, 1]), (1, [2 ** 30, 0]), (2, [2 ** 30, 1])]
    got = topk.top_k(spark.createDataFrame(big, kind), "id", "v", lambda i: i == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2 ** 60 + 1), (1, 2 ** 60)]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], [int(np.floor(64 * float(x))) for x in r["embedding"]]) for r in rows
               if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    got = queries.op5_topk(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == brute(vectors, lambda i: i % 20 == 0, 20)
