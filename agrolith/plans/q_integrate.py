"""Registered queries: integration, joins, group aggregates, cleaning (J*, A1-A4, I4, N*, F1-F2, X1-X2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.text import strip_all, title_case
from agrolith.operators import clean as C
from agrolith.operators import integrate as I
from agrolith.operators.quantile import exact_medians_many
from agrolith.plans import tables as TB
from agrolith.plans.registry import register
from agrolith.plans.tables import SQL_FILLED, SQL_FINAL, SQL_SOURCES, sql_title
from agrolith.session import stage_table

W = "WITH " + SQL_SOURCES


def merged_table(spark, d):
    """Cleaned sources joined onto the base, before any fill (order_key kept)."""
    m = I.merge_sources(TB.raw_sources(spark, d), TB.FIRST_TEMP_YEAR, base_extra=["order_key"])
    m = m.withColumn("order_key", F.col("order_key").cast("bigint"))
    return TB.promo_gap(m)


def integrated_table(spark, d, keep_key: bool = False):
    """J5 on the driver tables; with ``keep_key`` the order key rides along."""
    frames = TB.raw_sources(spark, d)
    extra = ["order_key"] if keep_key else []
    out = I.integrate(frames, TB.FIRST_TEMP_YEAR, adjust=TB.promo_gap, extra=extra)
    if keep_key:
        out = out.withColumn("order_key", F.col("order_key").cast("bigint"))
    return out


COLS7 = ("country, crop, CAST(year AS BIGINT) AS year, average_rain_fall_mm_per_year, avg_temp, "
         "pesticides_tonnes, yield_tonnes_per_ha")


@register("integrate_full", W + "," + SQL_FILLED + "," + SQL_FINAL + f"SELECT {COLS7} FROM final")
def integrate_full(spark, d):
    """Four sources cleaned, three left joins, group + global median fill, finalised."""
    return integrated_table(spark, d)


def _audit_sql(name, left, right):
    return f"""
SELECT '{name}' AS join_name, count(*) AS base_rows, count(k.rc) AS matched_rows,
       count(*) FILTER (WHERE k.rc IS NULL) AS unmatched_rows,
       CAST(sum(coalesce(k.rc, 1)) AS BIGINT) AS out_rows,
       CAST(sum(coalesce(k.rc, 1)) AS BIGINT) - count(*) AS fanout_rows,
       (SELECT count(*) FILTER (WHERE rc > 1) FROM (SELECT count(*) rc FROM {right} GROUP BY country, year)) AS dup_right_keys,
       (SELECT count(*) FROM (SELECT DISTINCT country, year FROM {right})) AS right_keys,
       (SELECT count(*) FROM {left} b2 WHERE EXISTS (SELECT 1 FROM {right} r2
           WHERE r2.country IS NOT DISTINCT FROM trim(b2.country) AND r2.year = b2.year)) AS matched_if_stripped
FROM {left} b LEFT JOIN (SELECT country, year, count(*) AS rc FROM {right} GROUP BY country, year) k
  ON b.country IS NOT DISTINCT FROM k.country AND b.year = k.year"""


# rainfall readings of 1999 come twice here, so that the first join fans out
_AUDIT_SQL = W + """,
rain2 AS (SELECT * FROM rain UNION ALL SELECT * FROM rain WHERE year = 1999),
m1 AS (SELECT b.* FROM base b LEFT JOIN rain2 r ON b.country IS NOT DISTINCT FROM r.country AND b.year = r.year),
m2 AS (SELECT b.* FROM m1 b LEFT JOIN temp r ON b.country IS NOT DISTINCT FROM r.country AND b.year = r.year)
""" + _audit_sql("rainfall", "base", "rain2") + "\nUNION ALL" + _audit_sql("temp", "m1", "temp") + \
    "\nUNION ALL" + _audit_sql("pesticides", "m2", "pest")


@register("join_left_audit", _AUDIT_SQL)
def join_left_audit(spark, d):
    """Each left join audited against the table it extends (matched, fan-out, dup keys)."""
    frames = TB.raw_sources(spark, d)
    rain = I.clean_rainfall(frames["rainfall"])
    return I.join_chain_audit(I.clean_base(frames["yield"]), {
        "rainfall": rain.unionByName(rain.where("year = 1999")),
        "temp": I.clean_temperature(frames["temp"], TB.FIRST_TEMP_YEAR),
        "pesticides": I.clean_pesticides(frames["pesticides"])})


_JT_ON = "b.country IS NOT DISTINCT FROM r.country AND b.year = r.year"


@register("join_type_counts", W + f"""
SELECT 'inner' AS join_type, (SELECT count(*) FROM base b JOIN rain r ON {_JT_ON}) AS rows
UNION ALL SELECT 'left', (SELECT count(*) FROM base b LEFT JOIN rain r ON {_JT_ON})
UNION ALL SELECT 'right', (SELECT count(*) FROM base b RIGHT JOIN rain r ON {_JT_ON})
UNION ALL SELECT 'outer', (SELECT count(*) FROM base b FULL JOIN rain r ON {_JT_ON})""")
def join_type_counts(spark, d):
    """Rows kept by inner / left / right / outer join of base and rainfall, from key counts."""
    frames = TB.raw_sources(spark, d)
    return I.join_type_counts(I.clean_base(frames["yield"]), I.clean_rainfall(frames["rainfall"]))


@register("group_mean", W + """
SELECT n_name AS country, CAST(y AS BIGINT) AS year, round_even(avg(5.0 + l_quantity * 0.5) * 1e4, 0) / 1e4 AS avg_temp
FROM sup GROUP BY n_name, y""")
def group_mean(spark, d):
    """A1: mean reading per (country, year), 4 places, all years."""
    return I.clean_temperature(TB.raw_temperature(spark, d), first_year=0)


@register("year_threshold", W + "SELECT country, CAST(year AS BIGINT) AS year, avg_temp FROM temp")
def year_threshold(spark, d):
    """F2 before A1: only years from the threshold are averaged."""
    return I.clean_temperature(TB.raw_temperature(spark, d), first_year=TB.FIRST_TEMP_YEAR)


@register("group_sum_zero", W + "SELECT country, CAST(year AS BIGINT) AS year, pesticides_tonnes FROM pest")
def group_sum_zero(spark, d):
    """A2: sum per (country, year); the all-blank key sums to 0."""
    return I.clean_pesticides(TB.raw_pesticides(spark, d))


_MED_COLS = ["average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes"]


def _unpivot_sql(src, keys):
    k = ", ".join(keys)
    sel = [f"SELECT {k + ', ' if k else ''}'{c}' AS measure, {c} AS value FROM {src}" for c in _MED_COLS]
    return " UNION ALL ".join(sel)


@register("group_median_fill", W + f""",
u AS ({_unpivot_sql('merged', ['crop'])})
SELECT crop, measure, median(value) AS median FROM u WHERE value IS NOT NULL GROUP BY crop, measure""")
def group_median(spark, d):
    """Exact median per crop of each measure (the values the group fill uses)."""
    from agrolith.plans.stage import merged
    return exact_medians_many(merged(spark, d), _MED_COLS, ["crop"], staged=True)


@register("global_median_fallback", W + "," + SQL_FILLED.replace("filled AS", "unused AS") + f""",
u AS ({_unpivot_sql('gfill', []).replace('average_rain_fall_mm_per_year AS value', 'rain_g AS value')
      .replace('avg_temp AS value', 'temp_g AS value').replace('pesticides_tonnes AS value', 'pest_g AS value')})
SELECT measure, median(value) AS median FROM u WHERE value IS NOT NULL GROUP BY measure""")
def global_median(spark, d):
    """A4 / I4: global median of each measure taken after the group fill."""
    from agrolith.plans.stage import merged
    m = merged(spark, d)
    gm = exact_medians_many(m, _MED_COLS, ["crop"], staged=True)
    wide = gm.groupBy("crop").pivot("measure", _MED_COLS).agg(F.first("median"))
    wide = stage_table(wide.select("crop", *[F.col(c).alias(f"_g_{c}") for c in _MED_COLS]), "group-medians")  # a row per crop
    f = m.join(wide, m.crop.eqNullSafe(wide.crop), "left").drop(wide.crop)
    for c in _MED_COLS:
        f = f.withColumn(c, F.coalesce(F.col(c), F.col(f"_g_{c}")))
    return exact_medians_many(f, _MED_COLS)


@register("clean_text_numbers", W.replace("WITH", "WITH", 1) + f""",
rr AS (
  SELECT n_name || ' ' AS area, y,
         CASE WHEN n_regionkey = 1 AND y = 1998 THEN '..' ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) END AS reading
  FROM sup WHERE n_regionkey <> 0 GROUP BY n_name, n_regionkey, y)
SELECT area AS raw_country, trim(area) AS country, {sql_title('area')} AS country_title,
       CAST(y AS BIGINT) AS year, reading AS raw_reading, TRY_CAST(reading AS DOUBLE) AS reading
FROM rr""")
def clean_text_numbers(spark, d):
    """N1, N6, N9, N10, X1, X2 on the raw rainfall text table."""
    raw = C.normalise_columns(TB.raw_rainfall(spark, d))
    cc = C.find_country_column(raw.columns)
    return raw.select(F.col(cc).alias("raw_country"), strip_all(cc).alias("country"),
                      title_case(cc).alias("country_title"), C.strict_int("year").alias("year"),
                      F.col("average_rain_fall_mm_per_year").alias("raw_reading"),
                      C.coerce_double("average_rain_fall_mm_per_year").alias("reading"))


@register("drop_missing_target", W + """
SELECT crop, count(*) FILTER (WHERE average_rain_fall_mm_per_year IS NOT NULL) AS kept_rows,
       count(*) FILTER (WHERE average_rain_fall_mm_per_year IS NULL) AS dropped_rows
FROM merged GROUP BY crop""")
def drop_missing_target(spark, d):
    """rows kept and dropped per crop when rows missing the rainfall value are dropped."""
    from agrolith.plans.stage import merged
    gone = F.col("average_rain_fall_mm_per_year").isNull()
    return merged(spark, d).groupBy("crop").agg(F.count_if(~gone).alias("kept_rows"), F.count_if(gone).alias("dropped_rows"))


# Ways of writing a number that raw tables carry; the order key picks one.
NUMBER_FORMS = ["{}", " {} ", "{}.0", "{}d", "{}f", "0x{}p3", "NAN", "nAn", "+{}", "{}e1", "-{}.5", "..", "NA", "", "1,{}", ".{}"]


@register("number_forms", """
WITH f AS (SELECT o_orderkey AS order_key, [""" + ", ".join(f"'{x}'" for x in NUMBER_FORMS) + """][CAST(o_orderkey % 16 AS BIGINT) + 1] AS form,
           CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
t AS (SELECT order_key, replace(form, '{}', y) AS raw FROM f),
v AS (SELECT *, regexp_matches(trim(raw), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS ok FROM t)
SELECT order_key, raw, CASE WHEN ok THEN CAST(trim(raw) AS DOUBLE) END AS number,
       CASE WHEN order_key % 16 IN (0, 1, 2, 8) THEN CAST(CAST(trim(raw) AS DOUBLE) AS BIGINT) END AS whole FROM v""")
def number_forms(spark, d):
    """Text numbers in sixteen forms; whole numbers may carry ``.0``, Java suffixes and NaN are no numbers."""
    o = TB.table(spark, d, "orders")
    forms = F.array(*[F.lit(x) for x in NUMBER_FORMS])
    pick = F.pmod("o_orderkey", F.lit(16)).cast("int")
    raw = F.replace(F.element_at(forms, pick + 1), F.lit("{}"), F.year("o_orderdate").cast("string"))
    t = o.select(F.col("o_orderkey").alias("order_key"), raw.alias("raw"), pick.isin(0, 1, 2, 8).alias("whole_form"))
    t = t.withColumn("_y", F.when(F.col("whole_form"), F.col("raw")).otherwise(F.lit("0")))
    return t.select("order_key", "raw", C.coerce_double("raw").alias("number"),
                    F.when(F.col("whole_form"), C.strict_int("_y")).alias("whole"))


__all__ = ["integrated_table", "merged_table"]
