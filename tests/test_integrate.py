import os

import pandas as pd
from pyspark.sql import functions as F

from agrolith.operators import integrate as I
from agrolith.operators.impute import group_median_fill
from agrolith.sources.csv import read_csv_strings


def test_rain_csv_cleanup(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "rain_raw.csv")
    with open(p, "w") as f:
        f.write(" Area,Year,average_rain_fall_mm_per_year\n")
        f.write("Albania ,1990,1485\nAlbania,1991,..\nAlgeria,1990,\nAlgeria,1991,NA\nAngola,1990,12\n")
    rain = I.clean_rainfall(read_csv_strings(spark, p))
    assert rain.columns == ["country", "year", "average_rain_fall_mm_per_year"]
    got = sorted((r.country, r.year, r.average_rain_fall_mm_per_year) for r in rain.collect())
    assert got == [("Albania", 1990, 1485.0), ("Albania", 1991, None), ("Algeria", 1990, None),
                   ("Algeria", 1991, None), ("Angola", 1990, 12.0)]


def test_null_safe_left_join_and_null_group_keys(spark):
    base = spark.createDataFrame([(None, 2000, 1.0), ("A", 2000, 2.0)], "country string, year int, v double")
    right = spark.createDataFrame([(None, 2000, 9.0), ("A", 2000, 8.0)], "country string, year int, r double")
    out = sorted(((r.country, r.r) for r in I.left_join(base, right).collect()), key=repr)
    assert out == sorted([(None, 9.0), ("A", 8.0)], key=repr)  # pandas merge matches null keys
    readings = spark.createDataFrame([(None, 2000, 1.0), ("A", 2000, 3.0), ("A", 2000, 5.0)],
                                     "country string, year int, t double")
    assert [(r.country, r.t) for r in I.group_mean(readings, ["country", "year"], "t").collect()] == [("A", 4.0)]


def test_sum_all_null_is_zero(spark):
    df = spark.createDataFrame([("A", 2000, None), ("A", 2000, None), ("B", 2000, 1.5)],
                               "country string, year int, v double")
    got = {r.country: r.v for r in I.group_sum_zero(df, ["country", "year"], "v").collect()}
    assert got == {"A": 0.0, "B": 1.5}


def test_fanout_audit_and_join_types(spark):
    base = spark.createDataFrame([("A", 2000), ("A", 2000), ("B", 2000), ("C ", 2000)], "country string, year int")
    right = spark.createDataFrame([("A", 2000), ("A", 2000), ("C", 2000), ("D", 2000)], "country string, year int")
    a = I.join_audit(base, right, name="r").first()
    assert (a.base_rows, a.matched_rows, a.unmatched_rows, a.out_rows, a.fanout_rows, a.dup_right_keys) == (4, 2, 2, 6, 2, 1)
    assert a.matched_if_stripped == 3
    assert a.out_rows == I.left_join(base, right).count()
    jt = {r.join_type: r.rows for r in I.join_type_counts(base, right).collect()}
    b, r = base.toPandas(), right.toPandas()
    for how in ("inner", "left", "right", "outer"):
        assert jt[how] == len(b.merge(r, on=["country", "year"], how=how))


def test_group_fill_then_global_fallback(spark):
    rows = [("x", 1.0), ("x", None), ("x", 3.0), ("y", 10.0), ("y", None), ("z", None), ("z", None)]
    df = spark.createDataFrame(rows, "crop string, v double")
    out = group_median_fill(df, ["v"], "crop").collect()
    pdf = pd.DataFrame(rows, columns=["crop", "v"])
    pdf["v"] = pdf.groupby("crop")["v"].transform(lambda s: s.fillna(s.median()))
    pdf["v"] = pdf["v"].fillna(pdf["v"].median())
    assert sorted((r.crop, r.v) for r in out) == sorted(pdf.itertuples(index=False, name=None))
    assert all(r.v is not None for r in out)


def test_integration_keeps_every_base_row(spark):
    from agrolith.plans import tables as TB
    from agrolith.plans.q_integrate import integrated_table
    d = "/root/testdata/sf0.001"
    base = TB.raw_yield(spark, d).count()
    out = integrated_table(spark, d)
    assert out.count() == base
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in nulls)


def test_integration_same_under_1_4_64_shuffle_partitions(spark):
    import __spark_entry__ as E
    q = E.queries()["integrate_full"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) > 0


def test_few_keys_do_not_deal_the_base_out(spark):
    """The sides are few keys made of many rows: their bytes are known before the base is planned, so it is not shuffled by key."""
    n = spark.range(30_000)
    country, year = F.concat(F.lit("N"), (F.col("id") % 3).cast("string")), (F.lit(2000) + F.col("id") % 2).cast("string")
    frames = {"yield": n.select(country.alias("Area"), F.lit("x").alias("Item"), year.alias("Year"), F.col("id").cast("string").alias("Value")),
              "rainfall": n.groupBy(country.alias("Area"), year.alias("Year")).agg(F.count(F.lit(1)).cast("string").alias("average_rain_fall_mm_per_year")),
              "temp": n.select(year.alias("year"), country.alias("country"), F.lit("7").alias("avg_temp")),
              "pesticides": n.select(country.alias("Area"), year.alias("Year"), F.lit("2").alias("Value"))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = I.merge_sources(frames)
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    assert out.count() == 30_000 and out.agg(F.sum("avg_temp")).first()[0] == 210_000.0
