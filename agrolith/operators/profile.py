"""Table profiles.

Every per-column statistic for all columns comes out of one aggregate and is
turned into one row per column with ``stack``; quartiles use the exact,
group-splitting quantile operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.functions.numeric import percent, round_half_even
from agrolith.functions.text import file_extension, parent_name, parent_path
from agrolith.operators.clean import find_target_column, split_by_type
from agrolith.operators.quantile import exact_quantiles, unpivot

# Image file extensions the listing accepts (any case).
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"]


def _long(row: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One aggregate row with ``<field>__<col>`` -> one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """A5 (+ F3): type, non-null count, null count and % (2 places) per column."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"non_null__{c}"), F.count_if(F.col(c).isNull()).alias(f"missing__{c}")]
    row = df.agg(*aggs)
    for c in cols:
        row = row.withColumn(f"dtype__{c}", F.lit(types[c]))
        row = row.withColumn(f"rows__{c}", F.col("_rows"))
    out = _long(row, cols, ["dtype", "non_null", "missing", "rows"])
    out = out.withColumn("missing_pct", percent("missing", "rows")).drop("rows")
    return out.where(F.col("missing") > 0) if only_missing else out


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, places: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear), max per numeric column."""
    cols = list(cols or split_by_type(df)["numeric"])
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    basic = _long(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(unpivot(df, cols, name_col="column"), "value", [0.25, 0.5, 0.75], ["column"], few=True)
    qw = q.groupBy("column").pivot("prob_id", [0, 1, 2]).agg(F.first("value")) \
        .select("column", F.col("0").alias("q25"), F.col("1").alias("q50"), F.col("2").alias("q75"))
    out = basic.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    if places is not None:
        for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]:
            out = out.withColumn(c, round_half_even(c, places))
    return out


def describe_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A7 (strings): count, unique, top (most frequent, ties to the smallest), freq."""
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    long = df.select(F.explode(pairs).alias("kv")).select("kv.column", "kv.v").where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("top"),
        F.max("n").alias("freq"))


def describe_all(df: DataFrame, places: int | None = 4) -> DataFrame:
    """Numeric and string columns in one long table (null where not applicable)."""
    kinds = split_by_type(df)
    num = describe_numeric(df, kinds["numeric"], places) if kinds["numeric"] else None
    st = describe_strings(df, kinds["categorical"]) if kinds["categorical"] else None
    parts = []
    if num is not None:
        parts.append(num.select("column", F.col("count").cast("long"), F.lit(None).cast("long").alias("unique"),
                                F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
                                "mean", "std", "min", "q25", "q50", "q75", "max"))
    if st is not None:
        parts.append(st.select("column", F.col("count").cast("long"), F.col("unique").cast("long"), "top",
                               F.col("freq").cast("long"),
                               *[F.lit(None).cast("double").alias(c) for c in
                                 ["mean", "std", "min", "q25", "q50", "q75", "max"]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_summary(df: DataFrame, year_col: str = "year", country_col: str = "country",
                  crop_col: str = "crop", approximate: bool = False) -> DataFrame:
    """Rows, columns, year range, distinct countries and crops (one row)."""
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
                  F.min(year_col).alias("year_min"), F.max(year_col).alias("year_max"),
                  cd(country_col).alias("countries"), cd(crop_col).alias("crops"))


def column_roles(df: DataFrame) -> DataFrame:
    """N5 / N7 as a table: column, type, kind, is_target."""
    kinds = split_by_type(df)
    target = find_target_column(df.columns)
    rows = []
    for f in df.schema.fields:
        kind = next((k for k, v in kinds.items() if f.name in v), "other")
        rows.append((f.name, f.dataType.simpleString(), kind, f.name == target))
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, kind string, is_target boolean")


def profile(df: DataFrame, places: int | None = 4) -> DataFrame:
    """One row per column: roles, missing counts, describe statistics."""
    roles = column_roles(df)
    miss = missing_report(df, only_missing=False).select("column", "non_null", "missing", "missing_pct")
    desc = describe_all(df, places)
    return roles.join(miss, "column", "left").join(desc.drop("count"), "column", "left")


# ---- file listings ------------------------------------------------------------

def list_files(spark, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """Files under ``root`` (recursive), path and length only; extension filter in any case."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "length"))
    df = df.withColumn("extension", file_extension("path"))
    if extensions is not None:
        df = df.where(F.col("extension").isin([e.lower() for e in extensions]))
    return df


def file_summary(listing: DataFrame) -> DataFrame:
    """Files and MB per extension."""
    return listing.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"),
        round_half_even(F.sum("length") / F.lit(1048576.0), 2).alias("mb"))


def class_summary(listing: DataFrame) -> DataFrame:
    """Images per class folder, and whether the layout is class-based."""
    per = listing.withColumn("class", parent_name("path")).withColumn("folder", parent_path("path"))
    counts = per.groupBy("class").agg(F.count(F.lit(1)).alias("images"))
    layout = per.agg((F.count_distinct("folder") > 1).alias("class_based"))
    return counts.crossJoin(layout)  # one-row layout flag


def image_folders(listing: DataFrame) -> DataFrame:
    """Distinct folders holding images."""
    return listing.select(parent_path("path").alias("folder")).distinct()
