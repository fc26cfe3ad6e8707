"""Repeatable splits, folds, samples and previews.

Membership comes from an md5 hash of (seed, row key), so it is independent of
partitioning and of row order, needs no global sort, and any SQL engine with
md5 computes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.functions.hashing import hash_bucket, hash_order
from agrolith.functions.numeric import percent


def hash_split(df: DataFrame, key_cols, seed: int = 42, test_share: float = 0.2,
               part_col: str = "part") -> DataFrame:
    """``part`` = 'test' when the md5 bucket (of 1000) is below ``test_share``."""
    cut = int(round(test_share * 1000))
    return df.withColumn(part_col, F.when(hash_bucket(seed, key_cols, 1000) < cut, F.lit("test"))
                         .otherwise(F.lit("train")))


def split_counts(df: DataFrame, part_col: str = "part") -> DataFrame:
    """Rows and % of total per part."""
    c = df.groupBy(part_col).agg(F.count(F.lit(1)).alias("rows"))
    tot = c.agg(F.sum("rows").alias("_tot"))
    return c.crossJoin(tot).select(part_col, "rows", percent("rows", "_tot").alias("pct"))


def hash_folds(df: DataFrame, key_cols, k: int = 3, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Fold in [0, k) from the md5 hash."""
    return df.withColumn(fold_col, hash_bucket(seed, key_cols, k))


def sample_n(df: DataFrame, key_cols, n: int, seed: int = 42) -> DataFrame:
    """T4 / T5: exactly ``min(n, rows)`` rows, uniform without replacement.

    ``orderBy(md5).limit(n)`` plans as a per-partition top-n plus one merge of
    at most n rows per partition; n is the requested sample size.
    """
    return df.withColumn("_h", hash_order(seed, key_cols)).orderBy("_h").limit(n).drop("_h")


def preview(df: DataFrame, order_cols: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in a stable key order."""
    return df.orderBy(*order_cols).limit(n)
