"""Driver tables and the keyed sources derived from them.

The reference integrates four country/year tables. On the driver's star schema
the same shapes come from the fact table, so every source grows with the data:

* ``yield`` (base): one row per line item; country = customer nation, year =
  order year, crop = part type, value = extended price. The country text of
  ``MACHINERY`` customers' 1996 orders carries a trailing blank, as raw keys
  sometimes do; the base key is not stripped before the join (reference rule).
* ``rainfall``: one reading per (supplier nation, ship year) = total quantity,
  header `` Area`` with a leading blank; nations of region 0 report nothing,
  region 1 reports the text ``..`` for 1998.
* ``temp``: one reading per line item (several per key) = 5 + quantity / 2,
  averaged per key; only years from 1997 are kept.
* ``pesticides``: one reading per returned line item (flag ``R``) = quantity / 4,
  summed per key; nations of region 3 report nothing, region 2 reports
  only blanks for 2001 (an all-missing key, which sums to 0).
* after the joins the temperature of crop ``PROMO`` is unknown, so one crop
  has no value at all and needs the global fallback.

All values are exact binary fractions, so sums and means are the same in any
engine and order. Readings arrive as text, like a CSV read as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FIRST_TEMP_YEAR = 1997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table. Join strategies are the planner's: it broadcasts by bytes."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _orders_with_country(spark, d) -> DataFrame:
    # orders x customer x nation first: the fact table then meets one
    # order-keyed table (one shuffle by order key) instead of three.
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Typed base view: order_key, country, year, crop, value (one row per line item)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    oc = _orders_with_country(spark, d)
    j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("l_orderkey").alias("order_key"), F.col("n_name").alias("country"),
                    F.year("o_orderdate").alias("year"), F.col("p_type").alias("crop"),
                    F.col("l_extendedprice").alias("value"))


def raw_yield(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    oc = _orders_with_country(spark, d)
    j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    yr = F.year("o_orderdate")
    area = F.when((F.col("c_mktsegment") == "MACHINERY") & (yr == 1996),
                  F.concat("n_name", F.lit(" "))).otherwise(F.col("n_name"))
    return j.select(F.lit("QCL").alias("Domain Code"), area.alias("Area"), F.col("p_type").alias("Item"),
                    yr.cast("string").alias("Year"), F.lit("hg/ha").alias("Unit"),
                    F.col("l_extendedprice").cast("string").alias("Value"),
                    F.col("l_orderkey").cast("string").alias("Order Key"))


def _supplier_nation(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name", "n_regionkey")


def raw_rainfall(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    # pre-aggregate per supplier and year before meeting the supplier table
    per_sup = li.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    sn = _supplier_nation(spark, d).where(F.col("n_regionkey") != 0)
    j = per_sup.join(sn, per_sup.l_suppkey == sn.s_suppkey)
    agg = j.groupBy("n_name", "n_regionkey", "y").agg(F.sum("q").cast("bigint").alias("q"))
    reading = F.when((F.col("n_regionkey") == 1) & (F.col("y") == 1998), F.lit("..")) \
        .otherwise(F.col("q").cast("string"))
    return agg.select(F.concat("n_name", F.lit(" ")).alias(" Area"), F.col("y").cast("string").alias("Year"),
                      reading.alias("average_rain_fall_mm_per_year"))


def raw_temperature(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    sn = _supplier_nation(spark, d)
    j = li.join(sn, li.l_suppkey == sn.s_suppkey)
    return j.select(F.year("l_shipdate").cast("string").alias("year"),
                    F.concat(F.lit(" "), "n_name").alias("country"),
                    (F.lit(5.0) + F.col("l_quantity") * F.lit(0.5)).cast("string").alias("avg_temp"))


def raw_pesticides(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R") \
        .select("l_suppkey", "l_quantity", "l_shipdate")
    sn = _supplier_nation(spark, d).where(F.col("n_regionkey") != 3)
    j = li.join(sn, li.l_suppkey == sn.s_suppkey)
    y = F.year("l_shipdate")
    val = F.when((F.col("n_regionkey") == 2) & (y == 2001), F.lit("")) \
        .otherwise((F.col("l_quantity") * F.lit(0.25)).cast("string"))
    return j.select(F.lit("Pesticides Use").alias("Domain"), F.col("n_name").alias("Area"),
                    F.lit("Use").alias("Element"), F.lit("Pesticides (total)").alias("Item"),
                    y.cast("string").alias("Year"), F.lit("tonnes").alias("Unit"), val.alias("Value"))


def raw_sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"yield": raw_yield(spark, d), "rainfall": raw_rainfall(spark, d),
            "temp": raw_temperature(spark, d), "pesticides": raw_pesticides(spark, d)}


def promo_gap(merged: DataFrame) -> DataFrame:
    """Temperature of crop PROMO is unknown (one group with no value)."""
    return merged.withColumn("avg_temp", F.when(F.col("crop") == "PROMO", F.lit(None).cast("double"))
                             .otherwise(F.col("avg_temp")))


# ---- DuckDB twins of the derivations above (oracle side) ---------------------

SQL_SOURCES = """
oc AS (
  SELECT o.o_orderkey, o.o_orderdate, c.c_mktsegment, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
base AS (
  SELECT l.l_orderkey AS order_key,
         CASE WHEN oc.c_mktsegment = 'MACHINERY' AND year(oc.o_orderdate) = 1996
              THEN oc.n_name || ' ' ELSE oc.n_name END AS country,
         p.p_type AS crop, CAST(year(oc.o_orderdate) AS INTEGER) AS year,
         l.l_extendedprice AS yield_hg_per_ha
  FROM lineitem l JOIN oc ON l.l_orderkey = oc.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
sup AS (
  SELECT l.l_quantity, l.l_returnflag, CAST(year(l.l_shipdate) AS INTEGER) AS y, n.n_name, n.n_regionkey
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
rain AS (
  SELECT n_name AS country, y AS year,
         CASE WHEN n_regionkey = 1 AND y = 1998 THEN NULL ELSE CAST(sum(l_quantity) AS DOUBLE) END
           AS average_rain_fall_mm_per_year
  FROM sup WHERE n_regionkey <> 0 GROUP BY n_name, n_regionkey, y),
temp AS (
  SELECT n_name AS country, y AS year, round_even(avg(5.0 + l_quantity * 0.5) * 1e4, 0) / 1e4 AS avg_temp
  FROM sup WHERE y >= 1997 GROUP BY n_name, y),
pest AS (
  SELECT n_name AS country, y AS year,
         coalesce(sum(CASE WHEN n_regionkey = 2 AND y = 2001 THEN NULL ELSE l_quantity * 0.25 END), 0.0)
           AS pesticides_tonnes
  FROM sup WHERE l_returnflag = 'R' AND n_regionkey <> 3 GROUP BY n_name, y),
merged AS (
  SELECT b.order_key, b.country, b.crop, b.year, b.yield_hg_per_ha, r.average_rain_fall_mm_per_year,
         CASE WHEN b.crop = 'PROMO' THEN NULL ELSE t.avg_temp END AS avg_temp, p.pesticides_tonnes
  FROM base b
  LEFT JOIN rain r ON b.country IS NOT DISTINCT FROM r.country AND b.year = r.year
  LEFT JOIN temp t ON b.country IS NOT DISTINCT FROM t.country AND b.year = t.year
  LEFT JOIN pest p ON b.country IS NOT DISTINCT FROM p.country AND b.year = p.year)
"""

SQL_FILLED = """
gfill AS (
  SELECT *,
    coalesce(average_rain_fall_mm_per_year, median(average_rain_fall_mm_per_year) OVER (PARTITION BY crop)) AS rain_g,
    coalesce(avg_temp, median(avg_temp) OVER (PARTITION BY crop)) AS temp_g,
    coalesce(pesticides_tonnes, median(pesticides_tonnes) OVER (PARTITION BY crop)) AS pest_g
  FROM merged),
filled AS (
  SELECT order_key, country, crop, year, yield_hg_per_ha,
    coalesce(rain_g, median(rain_g) OVER ()) AS average_rain_fall_mm_per_year,
    coalesce(temp_g, median(temp_g) OVER ()) AS avg_temp,
    coalesce(pest_g, median(pest_g) OVER ()) AS pesticides_tonnes
  FROM gfill)
"""


def sql_title(expr: str) -> str:
    """DuckDB twin of the title-case expression."""
    return (f"list_aggregate(list_transform(regexp_extract_all(lower(trim({expr})), "
            f"'(\\p{{L}}+|\\P{{L}}+)', 1), lambda x: upper(x[1:1]) || x[2:]), 'string_agg', '')")


SQL_FINAL = f"""
final AS (
  SELECT order_key, {sql_title('country')} AS country, {sql_title('crop')} AS crop, year,
         average_rain_fall_mm_per_year, avg_temp, pesticides_tonnes,
         round_even(yield_hg_per_ha * CAST(0.0001 AS DOUBLE) * 1e4, 0) / 1e4 AS yield_tonnes_per_ha
  FROM filled)
"""
