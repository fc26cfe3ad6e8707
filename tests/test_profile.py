import pytest

from agrolith.functions import clip_low
from agrolith.operators import profile as P
from agrolith.operators.clean import common_columns, find_country_column, find_target_column, split_by_type


def _df(spark):
    rows = [("Albania", "Maize", 1990, 1485.0, None), ("Albania", "Rice", 1991, None, 3.0),
            ("Algeria", "Maize", 1990, 89.0, 4.0), ("Algeria", "Maize", 1992, 89.0, 5.0)]
    return spark.createDataFrame(rows, "country string, crop string, year int, rain double, crop_yield double")


def test_roles_and_key_candidates(spark):
    df = _df(spark)
    kinds = split_by_type(df)
    assert kinds["numeric"] == ["year", "rain", "crop_yield"] and kinds["categorical"] == ["country", "crop"]
    assert find_target_column(df.columns) == "crop_yield"
    assert find_country_column(["_area", "year"]) == "_area"
    with pytest.raises(KeyError):
        find_country_column(["year"])
    assert common_columns({"a": df, "b": df.select("year", "country")}) == ["country", "year"]


def test_missing_and_describe_match_pandas(spark):
    df = _df(spark)
    pdf = df.toPandas()
    miss = {r.column: (r.missing, r.missing_pct) for r in P.missing_report(df).collect()}
    assert miss == {"rain": (1, 25.0), "crop_yield": (1, 25.0)}
    d = {r.column: r for r in P.describe_numeric(df, ["rain", "crop_yield"]).collect()}
    ref = pdf[["rain", "crop_yield"]].describe()
    for c in ["rain", "crop_yield"]:
        assert d[c]["count"] == ref[c]["count"]
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
            assert getattr(d[c], ours) == pytest.approx(ref[c][theirs])
    s = {r.column: r for r in P.describe_strings(df, ["country", "crop"]).collect()}
    assert (s["crop"].unique, s["crop"].top, s["crop"].freq) == (2, "Maize", 3)
    assert (s["country"].top, s["country"].freq) == ("Albania", 2)  # tie -> smallest


def test_profile_table_and_shape(spark):
    df = _df(spark)
    prof = {r.column: r for r in P.profile(df).collect()}
    assert set(prof) == set(df.columns)
    assert prof["crop_yield"].is_target and prof["rain"].missing == 1 and prof["crop"].unique == 2
    sh = P.shape_summary(df).first()
    assert (sh.rows, sh.columns, sh.year_min, sh.year_max, sh.countries, sh.crops) == (4, 5, 1990, 1992, 2, 2)


def test_clip_low(spark):
    got = [r.v for r in spark.createDataFrame([(-1.0,), (2.0,)], "x double").select(clip_low("x").alias("v")).collect()]
    assert got == [0.0, 2.0]
