"""Registered queries: impute, scale, encode, split, folds, sample, preview."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.numeric import round_half_even
from agrolith.operators import encode as E
from agrolith.operators import sample as S
from agrolith.operators import scale as SC
from agrolith.operators.impute import impute
from agrolith.plans import stage as ST
from agrolith.plans import tables as TB
from agrolith.plans.registry import register
from agrolith.plans.tables import SQL_FILLED, SQL_FINAL, SQL_SOURCES

W = "WITH " + SQL_SOURCES
MF = W + "," + SQL_FILLED + "," + SQL_FINAL + "," + ST.SQL_MF
MCOLS = ["average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes"]
FEATS = ["rain", "temp", "pest", "country_code", "crop_code"]


def r4(sql: str) -> str:
    return f"round_even(({sql}) * 1e4, 0) / 1e4"


def _impute_q(strategy):
    def q(spark, d):
        m = ST.merged(spark, d)
        out = impute(m, MCOLS, strategy)
        return out.select("order_key", "crop", *[round_half_even(c, 4).alias(c) for c in MCOLS])
    q.__doc__ = f"I1: fill the three measures with the column {strategy} (nulls from missing keys)."
    return q


def _impute_sql(stat):
    cols = ", ".join(f"{r4(f'coalesce({c}, {stat(c)})')} AS {c}" for c in MCOLS)
    return W + f"\nSELECT order_key, crop, {cols} FROM merged"


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM merged WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, v LIMIT 1)")


for _name, _strategy, _stat in [
    ("impute_mean", "mean", lambda c: f"(SELECT avg({c}) FROM merged)"),
    ("impute_median", "median", lambda c: f"(SELECT median({c}) FROM merged)"),
    ("impute_mode", "most_frequent", _mode_sql),
    ("impute_constant", "constant", lambda c: "0.0"),
]:
    register(_name, _impute_sql(_stat))(_impute_q(_strategy))


@register("scale_minmax", MF + f"""
SELECT order_key, crop, y, {', '.join(
    f"round_even(({c} - (SELECT min({c}) FROM mf)) / (CASE WHEN (SELECT max({c}) - min({c}) FROM mf) = 0 THEN 1.0 "
    f"ELSE (SELECT max({c}) - min({c}) FROM mf) END) * 1e6, 0) / 1e6 AS {c}" for c in FEATS)} FROM mf""")
def scale_minmax(spark, d):
    """Min-max scale of the five features; the target is left as it is."""
    mf = ST.model_frame(spark, d).select("order_key", "crop", "y", *FEATS)
    out, _ = SC.scale(mf, FEATS, "minmax")
    return out.select("order_key", "crop", "y", *[round_half_even(c, 6).alias(c) for c in FEATS])


def _std_sql(c):
    sd = f"(SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM mf)"
    return f"round_even(({c} - (SELECT avg({c}) FROM mf)) / {sd} * 1e6, 0) / 1e6 AS {c}"


@register("scale_standard", MF + f"\nSELECT order_key, crop, y, {', '.join(_std_sql(c) for c in FEATS)} FROM mf")
def scale_standard(spark, d):
    """Standard scale with the population std; a zero std divides by 1."""
    mf = ST.model_frame(spark, d).select("order_key", "crop", "y", *FEATS)
    out, _ = SC.scale(mf, FEATS, "standard")
    return out.select("order_key", "crop", "y", *[round_half_even(c, 6).alias(c) for c in FEATS])


@register("scale_inverse", MF + f"\nSELECT order_key, crop, y, {', '.join(r4(c) + ' AS ' + c for c in FEATS)} FROM mf")
def scale_inverse(spark, d):
    """The fitted scaler's inverse brings the scaled columns back."""
    mf = ST.model_frame(spark, d).select("order_key", "crop", "y", *FEATS)
    out, s = SC.scale(mf, FEATS, "standard")
    back = s.inverse(out)
    return back.select("order_key", "crop", "y", *[round_half_even(c, 4).alias(c) for c in FEATS])


_DICT_SQL = """
SELECT 'country' AS column, country AS value, CAST(dense_rank() OVER (ORDER BY country) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT country FROM final)
UNION ALL
SELECT 'crop', crop, CAST(dense_rank() OVER (ORDER BY crop) - 1 AS BIGINT) FROM (SELECT DISTINCT crop FROM final)"""


@register("label_encode", W + "," + SQL_FILLED + "," + SQL_FINAL + _DICT_SQL)
def label_encode(spark, d):
    """Dictionary of country and crop, code-point order -> 0..k-1."""
    return E.fit_encoders(ST.integrated(spark, d), ["country", "crop"])


@register("label_encode_unknown", W + "," + SQL_FILLED + "," + SQL_FINAL + f""",
dict AS ({_DICT_SQL})
SELECT e.event_id, 'Nation_' || CAST(e.user_id % 30 AS VARCHAR) AS country, coalesce(k.code, 0) AS country_code
FROM events e LEFT JOIN dict k ON k.column = 'country' AND k.value = 'Nation_' || CAST(e.user_id % 30 AS VARCHAR)""")
def label_encode_unknown(spark, d):
    """Request countries encoded; names absent from the dictionary get code 0."""
    ev = TB.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("Nation_"), F.pmod("user_id", F.lit(30)).cast("string")).alias("country"))
    out = E.encode(ev, ST.dictionary(spark, d), {"country": "country_code"})
    return out.select("event_id", "country", "country_code")


@register("label_decode", MF + """,
dict AS (SELECT DISTINCT crop, crop_code FROM mf)
SELECT m.order_key, m.y, m.crop_code, k.crop AS crop FROM mf m JOIN dict k ON m.crop_code = k.crop_code""")
def label_decode(spark, d):
    """Codes back to text through the stored dictionary."""
    mf = ST.model_frame(spark, d).select("order_key", "y", "crop_code")
    out = E.decode(mf, ST.dictionary(spark, d), {"crop_code": ("crop", "crop")})
    return out.select("order_key", "y", "crop_code", "crop")


@register("hash_split", MF + """
SELECT part, count(*) AS rows,
       round_even(CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM mf) AS DOUBLE) * 100 * 100, 0) / 100 AS pct
FROM mf GROUP BY part""")
def hash_split(spark, d):
    """80/20 split by md5 of the order key; rows and % per part."""
    return S.split_counts(ST.model_frame(spark, d))


@register("hash_folds", MF + "\nSELECT fold, part, count(*) AS rows FROM mf GROUP BY fold, part")
def hash_folds(spark, d):
    """Three folds by md5 of the order key, rows per fold and part."""
    return ST.model_frame(spark, d).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"))


_KEY_SQL = "CAST(order_key AS VARCHAR) || '|' || crop || '|' || CAST(CAST(round_even(y * 1e4, 0) AS BIGINT) AS VARCHAR)"


def row_key_cols():
    return ["order_key", "crop", F.rint(F.col("y") * F.lit(1e4)).cast("bigint")]


@register("sample_n", MF + f"""
SELECT order_key, crop, y, rain, temp, pest FROM mf ORDER BY md5('11|' || {_KEY_SQL}) LIMIT 500""")
def sample_n(spark, d):
    """T4: exactly 500 rows, uniform without replacement, repeatable by md5 order."""
    mf = ST.model_frame(spark, d)
    return S.sample_n(mf, row_key_cols(), 500, seed=11).select("order_key", "crop", "y", "rain", "temp", "pest")


@register("preview_topn", MF + "\nSELECT order_key, crop, y, rain, temp, pest FROM mf ORDER BY order_key, crop, y LIMIT 10")
def preview_topn(spark, d):
    """First 10 rows in key order."""
    mf = ST.model_frame(spark, d)
    return S.preview(mf, ["order_key", "crop", "y"], 10).select("order_key", "crop", "y", "rain", "temp", "pest")


@register("target_summary", MF + """
SELECT count(y) AS n, min(y) AS min, max(y) AS max, round_even(avg(y) * 1e4, 0) / 1e4 AS mean,
       round_even(stddev_samp(y) * 1e4, 0) / 1e4 AS std FROM mf""")
def target_summary(spark, d):
    """Range, mean and sample std of the target column."""
    from agrolith.operators.clean import target_summary as ts
    out = ts(ST.model_frame(spark, d), "y")
    return out.withColumn("mean", round_half_even("mean", 4)).withColumn("std", round_half_even("std", 4))


@register("sample_vectors", """
SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings ORDER BY md5('5|' || CAST(vec_id AS VARCHAR)) LIMIT 20""")
def sample_vectors(spark, d):
    """T5: n random items of the vector (image stand-in) table, repeatable by md5 order."""
    return S.sample_n(TB.table(spark, d, "embeddings").select("vec_id", "label"), ["vec_id"], 20, seed=5)
