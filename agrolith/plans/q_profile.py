"""Registered queries: table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.numeric import percent
from agrolith.operators import profile as P
from agrolith.plans import stage as ST
from agrolith.plans import tables as TB
from agrolith.plans.registry import register
from agrolith.plans.tables import SQL_FILLED, SQL_FINAL, SQL_SOURCES

W = "WITH " + SQL_SOURCES
MF = W + "," + SQL_FILLED + "," + SQL_FINAL + "," + ST.SQL_MF
R4 = "round_even(({}) * 1e4, 0) / 1e4"
MCOLS = ["average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes"]


def _missing_sql():
    parts = []
    for c in ["country", "crop", "year", "yield_hg_per_ha", "order_key", *MCOLS]:
        parts.append(f"SELECT '{c}' AS column, count({c}) AS non_null, count(*) - count({c}) AS missing, "
                     f"round_even(CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 * 100, 0) / 100 "
                     f"AS missing_pct FROM merged")
    return W + "\nSELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE missing > 0"


@register("missing_report", _missing_sql())
def missing_report(spark, d):
    """A5 + F3: null count and % per column of the joined table, columns with gaps only."""
    return P.missing_report(ST.merged(spark, d)).drop("dtype")


_DCOLS = ["rain", "temp", "pest", "y"]


def _describe_sql():
    parts = []
    for c in _DCOLS:
        parts.append(
            f"SELECT '{c}' AS column, count({c}) AS count, {R4.format(f'avg({c})')} AS mean, "
            f"{R4.format(f'stddev_samp({c})')} AS std, {R4.format(f'min({c})')} AS min, "
            f"{R4.format(f'quantile_cont({c}, 0.25)')} AS q25, {R4.format(f'quantile_cont({c}, 0.5)')} AS q50, "
            f"{R4.format(f'quantile_cont({c}, 0.75)')} AS q75, {R4.format(f'max({c})')} AS max FROM mf")
    return MF + "\n" + " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql())
def describe_numeric(spark, d):
    """Count, mean, sample std, min, exact linear quartiles, max of the model features."""
    return P.describe_numeric(ST.model_frame(spark, d), _DCOLS, places=4)


def _describe_all_sql():
    num = []
    for c in ["year", "average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes", "yield_tonnes_per_ha"]:
        num.append(
            f"SELECT '{c}' AS column, count({c}) AS count, CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, "
            f"CAST(NULL AS BIGINT) AS freq, {R4.format(f'avg({c})')} AS mean, {R4.format(f'stddev_samp({c})')} AS std, "
            f"{R4.format(f'min({c})')} AS min, {R4.format(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{R4.format(f'quantile_cont({c}, 0.5)')} AS q50, {R4.format(f'quantile_cont({c}, 0.75)')} AS q75, "
            f"{R4.format(f'max({c})')} AS max FROM final")
    st = []
    for c in ["country", "crop"]:
        st.append(
            f"SELECT '{c}' AS column, sum(n) AS count, count(*) AS unique, "
            f"arg_min(v, (-n, v)) AS top, max(n) AS freq, NULL, NULL, NULL, NULL, NULL, NULL, NULL "
            f"FROM (SELECT {c} AS v, count(*) AS n FROM final GROUP BY {c})")
    return W + "," + SQL_FILLED + "," + SQL_FINAL + "\n" + " UNION ALL ".join(num + st)


@register("describe_all", _describe_all_sql())
def describe_all(spark, d):
    """Describe with strings (count, unique, top, freq) over the integrated table."""
    t = ST.integrated(spark, d).drop("order_key")
    return P.describe_all(t, places=4)


@register("shape_summary", W + "," + SQL_FILLED + "," + SQL_FINAL + """
SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns, CAST(min(year) AS BIGINT) AS year_min,
       CAST(max(year) AS BIGINT) AS year_max, count(DISTINCT country) AS countries, count(DISTINCT crop) AS crops
FROM final""")
def shape_summary(spark, d):
    """Rows, columns, year range, distinct countries and crops of the integrated table."""
    return P.shape_summary(ST.integrated(spark, d).drop("order_key"))


@register("class_counts", """
SELECT CAST(label AS BIGINT) AS label, count(*) AS images,
       round_even(CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) * 100 * 100, 0) / 100 AS pct
FROM embeddings GROUP BY label""")
def class_counts(spark, d):
    """Items per class of the vector table, with % of all."""
    e = TB.table(spark, d, "embeddings")
    c = e.groupBy("label").agg(F.count(F.lit(1)).alias("images"))
    tot = e.agg(F.count(F.lit(1)).alias("_t"))  # one row
    return c.crossJoin(tot).select("label", "images", percent("images", "_t").alias("pct"))


_COLUMNS = ["country", "crop", "year", "average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes", "yield_tonnes_per_ha"]


def _roles_sql(columns, src, candidates=None):
    """Types from the engine, kinds from the types, the target by the candidate list."""
    from agrolith.operators.clean import TARGET_CANDIDATES
    names = "[" + ", ".join(f"'{c}'" for c in (candidates or TARGET_CANDIDATES)) + "]"
    one = " UNION ALL ".join(f"SELECT '{c}' AS column, any_value(typeof({c})) AS t FROM {src}" for c in columns)
    return f"""
ty AS ({one}),
po AS (SELECT *, list_position({names}, lower(ty."column")) AS p FROM ty),
roles AS (SELECT po."column",
    CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' ELSE lower(t) END AS dtype,
    CASE WHEN t IN ('VARCHAR', 'BOOLEAN') THEN 'categorical' WHEN t IN ('DATE', 'TIMESTAMP') THEN 'datetime' ELSE 'numeric' END AS kind,
    coalesce(p = (SELECT min(p) FROM po WHERE p > 0), false) AS is_target FROM po)"""


def _profile_sql():
    miss = " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS non_null, count(*) - count({c}) AS missing, "
        f"round_even(CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 * 100, 0) / 100 AS missing_pct "
        f"FROM final" for c in _COLUMNS)
    return (W + "," + SQL_FILLED + "," + SQL_FINAL + "," + _roles_sql(_COLUMNS, "final") + f""",
miss AS ({miss}),
descr AS ({_describe_all_sql()[len(W + "," + SQL_FILLED + "," + SQL_FINAL):]})
SELECT r.column, r.dtype, r.kind, r.is_target, m.non_null, m.missing, m.missing_pct,
       d.unique, d.top, d.freq, d.mean, d.std, d.min, d.q25, d.q50, d.q75, d.max
FROM roles r LEFT JOIN miss m ON r.column = m.column LEFT JOIN descr d ON r.column = d.column""")


@register("profile_table", _profile_sql())
def profile_table(spark, d):
    """One row per column of the integrated table: type, role, target flag, gaps, statistics."""
    t = ST.integrated(spark, d).drop("order_key")
    return P.profile(t, places=4)


@register("column_roles", W + f"""
, v1 AS (SELECT country AS area, yield_hg_per_ha AS value, year, yield_hg_per_ha AS production FROM base),
v2 AS (SELECT country, yield_hg_per_ha AS crop_yield, crop, yield_hg_per_ha AS yield FROM base),
v3 AS (SELECT country, year FROM base)
""" + "".join(
    f", x{i} AS (WITH {_roles_sql(cols, src)} SELECT '{name}' AS view_name, * FROM roles)"
    for i, (name, src, cols) in enumerate([("raw", "v1", ["area", "value", "year", "production"]),
                                           ("named", "v2", ["country", "crop_yield", "crop", "yield"]), ("plain", "v3", ["country", "year"])]))
    + " SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2")
def column_roles(spark, d):
    """Types, roles and the guessed target of three views of the base table."""
    from agrolith.operators.integrate import clean_base
    b = clean_base(TB.raw_yield(spark, d))
    y = F.col("yield_hg_per_ha")
    views = {"raw": b.select(F.col("country").alias("area"), y.alias("value"), "year", y.alias("production")),
             "named": b.select("country", y.alias("crop_yield"), "crop", y.alias("yield")),
             "plain": b.select("country", "year")}
    out = None
    for name, v in views.items():
        r = P.column_roles(v).select(F.lit(name).alias("view_name"), "*")
        out = r if out is None else out.unionByName(r)
    return out
