import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators.importance import permutation_importance
from agrolith.operators.metrics import kernel_density
from agrolith.operators.rank import global_rank, with_permuted


def by_hand(x, n, key):
    a = next(a for a in range(1, n + 2) if a * a >= n)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(4):
            noise = int(hashlib.md5(f"{key}|{i}|{left if i % 2 else right}".encode()).hexdigest()[:8], 16)
            left, right = (left, (right + noise) % b) if i % 2 else ((left + noise) % a, right)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permuted_is_a_bijection(spark, n):
    for r in range(3):
        key = f"0|{r}"
        got = [x["p"] for x in with_permuted(spark.range(n), "id", n, F.lit(key), "p").orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and got == [by_hand(x, n, key) for x in range(n)]
        if n == 1000:
            assert got != list(range(n)) and abs(np.corrcoef(got, range(n))[0, 1]) < 0.1


def test_global_rank_with_ties_any_layout(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int")
    want = {(a, b): r for r, (a, b) in enumerate(sorted((i % 7, i) for i in range(500)))}
    for p in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        try:
            got = {(r["a"], r["b"]): r["rank"] for r in global_rank(df.repartition(5), ["a", "b"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert got == want
    assert global_rank(df.limit(0), ["a"]).count() == 0


def test_importance_equals_a_loop_at_any_number_of_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2)), 0.0) for i in range(300)]
    rows = [(i, a, b, 2 * a - 0.5 * b + float(rng.normal(scale=0.1))) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    predict = lambda t: t.withColumn("pred", 2 * F.col("a") - 0.5 * F.col("b"))
    results = []
    for p in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        try:
            out = permutation_importance(df.repartition(3), ["a", "b"], predict, "y", ["k"], repeats=2, places=None).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        results.append({(r["feature"], r["repeat"]): r["importance"] for r in out})
    order = sorted(rows, key=lambda r: hashlib.md5(f"1|{r[0]}".encode()).hexdigest())
    a, b, y = (np.array([r[i] for r in order]) for i in (1, 2, 3))
    r2 = lambda p: 1 - ((y - p) ** 2).sum() / (y.var() * len(y))
    for rep in range(2):
        to = [by_hand(i, 300, f"0|{rep}") for i in range(300)]
        for f, pred in (("a", 2 * a[to] - 0.5 * b), ("b", 2 * a - 0.5 * b[to])):
            for got in results:
                assert abs(got[f, rep] - (r2(2 * a - 0.5 * b) - r2(pred))) < 1e-9


def test_importance_scores_each_feature_row_once(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("b"),
                                 F.when(F.col("id") != 7, F.col("id").cast("double")).alias("y"))
    scored = spark.sparkContext.accumulator(0)

    def predict(t):
        def count(batches):
            for b in batches:
                scored.add(b.num_rows)
                yield b
        return t.mapInArrow(count, t.schema).withColumn("pred", 100.0 * F.col("a") - F.col("b"))
    got = {(r["feature"], r["repeat"]): r["importance"] for r in permutation_importance(df, ["a", "b"], predict, "y", ["id"], repeats=2).collect()}
    assert scored.value <= 2 * 3 * 12  # repeats, variants, feature rows
    assert len(got) == 4 and all(v is not None for v in got.values())


def test_density_has_every_point(spark):
    v = np.concatenate([np.random.default_rng(2).normal(size=3000), [25.0]])  # an empty stretch before the last value
    got = kernel_density(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").orderBy("point").collect()
    assert len(got) == 200 and got[150]["density"] == 0.0
    bw = v.std(ddof=1) * len(v) ** -0.2
    exact = [np.exp(-0.5 * ((r["place"] - v) / bw) ** 2).sum() / (len(v) * bw * np.sqrt(2 * np.pi)) for r in got]
    assert max(abs(r["density"] - e) for r, e in zip(got, exact)) < 0.01
    one = kernel_density(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").collect()
    assert len(one) == 200 and all(r["density"] is None for r in one)
    assert kernel_density(spark.createDataFrame([], "v double"), "v").count() == 0
