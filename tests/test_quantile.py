import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators.quantile import exact_median, exact_medians_many, exact_quantiles


def _ref(vals, p):
    return float(np.quantile(np.asarray(vals, dtype=float), p, method="linear"))


@pytest.mark.parametrize("accuracy", [10_000, 50, 100])
def test_grouped_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    rows = []
    # one hot group with a third of the rows, heavy ties, and small groups
    for i in range(900):
        g = "hot" if i % 3 == 0 else f"g{i % 7}"
        v = float(rng.integers(0, 20)) if g == "hot" else float(rng.normal())
        rows.append((g, v))
    rows += [("nulls", None), ("nulls", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    q = exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy).collect()
    got = {(r.g, r.prob_id): r.value for r in q}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert "nulls" not in {k[0] for k in got}
    for g, vals in groups.items():
        for i, p in enumerate(probs):
            assert got[(g, i)] == pytest.approx(_ref(vals, p), abs=1e-12), (g, p)


def test_global_median_and_partition_layout(spark):
    vals = [float(x) for x in [5, 1, 4, 2, 3, 10, 7, 8]]
    for parts in (1, 4, 64):
        df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(parts)
        assert exact_median(df, "v").first()["median"] == 4.5
        assert exact_median(df, "v", accuracy=2).first()["median"] == 4.5


@pytest.mark.parametrize("accuracy", [2, 5, 10_000])
def test_tied_ranks_end(spark, accuracy):
    """Two values, half and half: the ranks of the median lie on both; one value: nothing to narrow."""
    for parts in (1, 64):
        df = spark.createDataFrame([(float(i % 2),) for i in range(20)], "v double").repartition(parts)
        assert exact_median(df, "v", accuracy=accuracy).first()["median"] == 0.5
    same = spark.createDataFrame([("a", 3.0)] * 9 + [("b", 1.0)] * 4 + [("b", 2.0)] * 4 + [(None, 7.0)], "g string, v double")
    got = {r.g: r.median for r in exact_median(same, "v", ["g"], accuracy=accuracy).collect()}
    assert got == {"a": 3.0, "b": 1.5, None: 7.0}


def test_extreme_values_end(spark):
    values = [-1.7e308, 1.7e308, 5e-324, 0.0, float("inf"), float("-inf"), 1.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.value for r in exact_quantiles(df, "v", [0.0, 0.5, 1.0], accuracy=4).orderBy("prob_id").collect()]
    assert got == [float("-inf"), 5e-324, float("inf")]


@pytest.mark.parametrize("shape", ["normal", "sorted", "skewed", "two_values"])
def test_brackets_hold_on_large_groups_of_any_layout(spark, shape):
    """Many more rows than the summary keeps: both passes are at work, and the plan builds without a job."""
    rng = np.random.default_rng(4)
    v = {"normal": rng.normal(size=60_000), "sorted": np.arange(60_000.0), "skewed": np.exp(rng.normal(scale=6, size=60_000)),
         "two_values": (np.arange(60_000) % 2).astype(float)}[shape]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    for parts in (3, 40):
        before = jobs()
        q = exact_quantiles(df.repartition(parts), "v", [0.001, 0.25, 0.5, 0.9999], accuracy=200)
        assert jobs() == before
        assert [r.value for r in q.orderBy("prob_id").collect()] == pytest.approx([_ref(v, p) for p in (0.001, 0.25, 0.5, 0.9999)], abs=0, rel=1e-15)


def test_rows_are_not_dealt_out_by_a_few_groups(spark):
    """Where groups are few, the rows meet the brackets without a shuffle by group, which puts each group in one task."""
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 1000).cast("double").alias("v"),
                                    F.col("id").cast("double").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        staged = exact_median(df, "v", ["g"], staged=True)
        many = exact_medians_many(df, ["v", "w"])
        one = exact_median(df, "v")
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (staged, many, one)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("Broadcast" in p for p in plans)
    v = np.arange(30_000) % 1000
    assert {r.g: r.median for r in staged.collect()} == {str(g): float(np.median(v[g::3])) for g in range(3)}
    assert {r.measure: r.median for r in many.collect()} == {"v": 499.5, "w": 14_999.5} and one.first()["median"] == 499.5
    assert exact_medians_many(df.limit(0), ["v", "w"]).count() == 0 and exact_median(df.limit(0), "v").count() == 0
