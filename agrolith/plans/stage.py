"""Stage tables: a job's output written once as Parquet and read by the next jobs.

The reference hands its integrated table to the modelling jobs as a file; here
the file lives under the session's checkpoint folder (the shared folder the
cluster names in ``spark.checkpoint.dir``), one folder per application, so a
lost executor never loses it and the modelling plans start from a short
lineage.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.operators.encode import encode, fit_encoders
from agrolith.operators.sample import hash_folds, hash_split
from agrolith.session import checkpoint_dir

_DONE: dict[tuple, str] = {}

SPLIT_SEED = 42
FOLD_SEED = 7
FEATURES = ["country_code", "crop_code", "rain", "temp", "pest"]


def signature(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the input folder's tables: names, sizes and times of change (one directory listing)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir.rstrip("/"))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    parts = sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in found)
    return hashlib.md5("|".join([sf_dir.rstrip("/"), *parts]).encode()).hexdigest()[:12]


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stage table ``name`` of an input folder, built when it is not there or the input has changed."""
    app = spark.sparkContext.applicationId
    tag = signature(spark, sf_dir)
    key = (app, tag, name)
    path = _DONE.get(key)
    if path is None:
        path = f"{checkpoint_dir(spark).rstrip('/')}/agrolith-stage/{app}/{tag}/{name}"
        build().write.mode("overwrite").parquet(path)
        _DONE[key] = path
    return spark.read.parquet(path)


def merged(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned sources joined onto the base, before any fill (order_key kept)."""
    from agrolith.plans.q_integrate import merged_table
    return stage(spark, d, "merged", lambda: merged_table(spark, d))


def integrated(spark: SparkSession, d: str) -> DataFrame:
    """Fill + finalise of the staged joined table (the same result as the integration job)."""
    from agrolith.operators.integrate import finalise, post_merge_fill

    def build():
        out = finalise(post_merge_fill(merged(spark, d)), ["order_key"])
        return out.withColumn("order_key", F.col("order_key").cast("bigint"))
    return stage(spark, d, "integrated", build)


def model_frame(spark: SparkSession, d: str) -> DataFrame:
    """Integrated table + label codes + split part + fold, short feature names."""
    def build():
        t = integrated(spark, d).select(
            "order_key", "country", "crop", "year",
            F.col("average_rain_fall_mm_per_year").alias("rain"), F.col("avg_temp").alias("temp"),
            F.col("pesticides_tonnes").alias("pest"), F.col("yield_tonnes_per_ha").alias("y"))
        # the dictionary as a table: its few bytes are known, so the rows are not dealt out by crop to meet it
        t = encode(t, dictionary(spark, d), {"country": "country_code", "crop": "crop_code"})
        t = hash_split(t, "order_key", SPLIT_SEED)
        return hash_folds(t, "order_key", 3, FOLD_SEED)
    return stage(spark, d, "model_frame", build)


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "dictionary", lambda: fit_encoders(integrated(spark, d), ["country", "crop"]))


# DuckDB twin of model_frame (after SQL_SOURCES, SQL_FILLED, SQL_FINAL)
SQL_MF = """
mf AS (
  SELECT order_key, country, crop, CAST(year AS BIGINT) AS year,
         average_rain_fall_mm_per_year AS rain, avg_temp AS temp, pesticides_tonnes AS pest,
         yield_tonnes_per_ha AS y,
         CAST(dense_rank() OVER (ORDER BY country) - 1 AS BIGINT) AS country_code,
         CAST(dense_rank() OVER (ORDER BY crop) - 1 AS BIGINT) AS crop_code,
         CASE WHEN (('0x' || substr(md5('42|' || CAST(order_key AS VARCHAR)), 1, 8))::UBIGINT % 1000) < 200
              THEN 'test' ELSE 'train' END AS part,
         CAST((('0x' || substr(md5('7|' || CAST(order_key AS VARCHAR)), 1, 8))::UBIGINT % 3) AS BIGINT) AS fold
  FROM final)
"""
