"""Label encoding (E1-E3): code-point order -> 0..k-1, unseen -> 0, inverse.

The dictionary is built without a global single-partition window: distinct
values are range-partitioned, numbered inside each partition, and shifted by
the running count of the partitions before them (a table of one row per
partition). Codes are applied by a join, so the planner may broadcast the
dictionary when its measured size is small and sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.session import stage_table


def dense_codes(df: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """Distinct non-null values of ``col`` with their 0-based rank in value order."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    d = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranged = d.repartitionByRange(parts, "value").withColumn("_pid", F.spark_partition_id())
    ranged = stage_table(ranged, "dictionary")  # both branches read one partitioning, also after a lost executor
    local = ranged.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid").orderBy("value")))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, so a global window here is cheap
    offs = sizes.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1))).select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offs), "_pid").select(
        "value", (F.col("_off") + F.col("_lr") - 1).cast("int").alias(code_col))


def fit_encoders(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long dictionary ``(column, value, code)`` for several string columns."""
    out = None
    for c in cols:
        m = dense_codes(df, c).select(F.lit(c).alias("column"), "value", "code")
        out = m if out is None else out.unionByName(m)
    return out


def encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str] | Mapping[str, str],
           unseen: int = 0) -> DataFrame:
    """Replace each column by its code; values absent from the dictionary get ``unseen``.

    ``cols`` may map source column -> output column; by default codes replace the text.
    """
    mapping = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    out = df
    for src, dst in mapping.items():
        m = dictionary.where(F.col("column") == src).select(
            F.col("value").alias(f"_v_{src}"), F.col("code").alias(f"_c_{src}"))
        out = out.join(m, out[src] == m[f"_v_{src}"], "left")
        out = out.withColumn(dst, F.coalesce(F.col(f"_c_{src}"), F.lit(unseen)).cast("int"))
        out = out.drop(f"_v_{src}", f"_c_{src}")
    return out


def decode(df: DataFrame, dictionary: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Code column -> text column (``{code_col: (source column name, output)}``)."""
    out = df
    for code_col, spec in cols.items():
        src, dst = spec if isinstance(spec, tuple) else (spec, spec)
        m = dictionary.where(F.col("column") == src).select(
            F.col("code").alias(f"_k_{code_col}"), F.col("value").alias(f"_t_{code_col}"))
        out = out.join(m, out[code_col] == m[f"_k_{code_col}"], "left")
        out = out.withColumn(dst, F.col(f"_t_{code_col}")).drop(f"_k_{code_col}", f"_t_{code_col}")
    return out
