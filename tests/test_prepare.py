import pytest

from agrolith.operators import encode as E
from agrolith.operators import sample as S
from agrolith.operators import scale as SC
from agrolith.operators.impute import impute


def test_mode_ties_smallest_and_impute_strategies(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (1.0,), (2.0,), (3.0,), (None,)], "v double")
    for strategy, want in [("most_frequent", 1.0), ("mean", 1.8), ("median", 2.0), ("constant", 0.0)]:
        got = [r.v for r in impute(df, ["v"], strategy).collect()]
        assert got[-1] == pytest.approx(want) and got[:5] == [2.0, 1.0, 1.0, 2.0, 3.0]


def test_impute_strings_and_all_null_error(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert impute(df, ["s"], "most_frequent", categorical=True).collect()[-1].s == "a"
    assert impute(df, ["s"], "constant", categorical=True).collect()[-1].s == "missing_value"
    bad = spark.createDataFrame([(None,), (None,)], "v double")
    with pytest.raises(Exception):
        impute(bad, ["v"], "mean").collect()
    with pytest.raises(ValueError):
        impute(df, ["s"], "nope")


def test_constant_column_scales_to_zero_and_inverse(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 4.0)], "c double, x double")
    for method in ("minmax", "standard"):
        out, s = SC.scale(df, ["c", "x"], method)
        assert [r.c for r in out.collect()] == [0.0, 0.0, 0.0]
        back = s.inverse(out).collect()
        assert [round(r.x, 12) for r in back] == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        SC.fit(df, ["x"], "robust")


def test_standard_scale_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out, _ = SC.scale(df, ["x"], "standard")
    assert sorted(r.x for r in out.collect()) == [-1.0, 1.0]


def test_encode_unseen_and_roundtrip(spark):
    df = spark.createDataFrame([(c,) for c in ["b", "a", "c", "a", "é"]], "k string")
    d = E.fit_encoders(df, ["k"])
    codes = {r.value: r.code for r in d.collect()}
    assert codes == {"a": 0, "b": 1, "c": 2, "é": 3}
    req = spark.createDataFrame([("c",), ("zzz",)], "k string")
    enc = E.encode(req, d, {"k": "code"})
    assert sorted((r.k, r.code) for r in enc.collect()) == [("c", 2), ("zzz", 0)]
    back = E.decode(E.encode(df, d, {"k": "code"}).drop("k"), d, {"code": ("k", "k")})
    assert sorted(r.k for r in back.collect()) == sorted(r.k for r in df.collect())


def test_split_is_partition_and_layout_stable(spark):
    base = spark.range(2000).withColumnRenamed("id", "key")
    results = []
    for parts in (1, 4, 64):
        s = S.hash_split(base.repartition(parts), "key", seed=42)
        results.append(sorted((r.key, r.part) for r in s.collect()))
    assert results[0] == results[1] == results[2]
    parts = {p for _, p in results[0]}
    assert parts == {"train", "test"} and len(results[0]) == 2000
    share = sum(1 for _, p in results[0] if p == "test") / 2000
    assert 0.15 < share < 0.25
    folds = S.hash_folds(base, "key", 3).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2]


def test_sample_exact_size_and_repeatable(spark):
    base = spark.range(1000).withColumnRenamed("id", "key")
    a = sorted(r.key for r in S.sample_n(base.repartition(7), ["key"], 123, seed=5).collect())
    b = sorted(r.key for r in S.sample_n(base.repartition(3), ["key"], 123, seed=5).collect())
    assert a == b and len(a) == 123 and len(set(a)) == 123
