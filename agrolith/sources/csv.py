"""CSV sources and sinks.

CSV is read with a header and every column as text; missing-value tokens
become null and names are normalised afterwards, so typing is always an
explicit, checked step (N9, N10).
"""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.functions.text import null_tokens_to_null
from agrolith.operators.clean import normalise_columns
from agrolith.session import stage_table


def read_csv_strings(spark: SparkSession, path: str, map_null_tokens: bool = True) -> DataFrame:
    """Header row, all columns as strings; an absent path raises PATH_NOT_FOUND."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if map_null_tokens:
        df = df.select(*[null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def load_named(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Read each named CSV, skip absent files, normalise headers."""
    out = {}
    for name, path in paths.items():
        try:
            df = read_csv_strings(spark, path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e.getCondition() or e):
                continue
            raise
        out[name] = normalise_columns(df)
    return out


@dataclass
class CsvGroup:
    """All good files with the same columns, as one table (all text, ``_file`` = the path)."""

    columns: list[str]
    files: int
    rows: DataFrame


def scan_csv_tree(spark: SparkSession, root: str) -> DataFrame:
    """S3 (report): one row per ``.csv`` file under ``root`` (any case): path, header, fields, lines, widest line, error.

    One pass over all files in Spark tasks, whatever their number. A file is
    bad when it is empty or its header is blank, when a line is not UTF-8, or
    when a line has more fields than the header (fewer are nulls).
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(root)
    # the file index has all paths, those of empty files too, which no scan returns
    paths = [f.replace("file:///", "file:/", 1) for f in texts.inputFiles() if f.lower().endswith(".csv")]
    listing = spark.createDataFrame([(f,) for f in paths], "path string")
    lines = texts.select(F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value") \
        .where(F.lower(F.col("path")).endswith(".csv"))
    valid = F.is_valid_utf8("value")
    # separators outside quoted fields
    plain = F.regexp_replace("value", '"([^"]|"")*"', "")
    fields = F.when(valid, F.length(plain) - F.length(F.regexp_replace(plain, ",", "")) + 1)
    seen = lines.select("path", "value", fields.alias("fields"), valid.alias("valid"), F.struct("block", F.monotonically_increasing_id()).alias("at")) \
        .groupBy("path").agg(F.min_by(F.struct("value", "fields"), "at").alias("head"), F.max("fields").alias("widest"),
                             F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("valid")).alias("invalid"))
    out = listing.join(seen, "path", "left").select(
        "path", F.col("head.value").alias("header"), F.col("head.fields").alias("fields"), F.coalesce("lines", F.lit(0)).alias("lines"), "widest", "invalid")
    return out.withColumn("error", F.when(F.trim(F.coalesce("header", F.lit(""))) == "", "no columns").when(F.col("invalid") > 0, "not UTF-8")
                          .when(F.col("widest") > F.col("fields"), F.concat(F.lit("expected "), F.col("fields").cast("string"), F.lit(" fields, saw "),
                                                                            F.col("widest").cast("string"))))


def _unique(names: list[str]) -> list[str]:
    """Repeated header names get a number, as a data frame library gives them: a, a.1, a.2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(n if n not in seen else f"{n}.{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def read_csv_tree(spark: SparkSession, root: str, map_null_tokens: bool = True) -> tuple[list[CsvGroup], DataFrame]:
    """S3: every CSV under ``root``: the good files as one table per header, and the report of all files.

    Files are grouped by the fingerprint of their header, and each group is one
    scan, so the number of plans follows the headers and not the files. The
    driver holds the paths (as Spark's file index does) and one header per group.
    """
    report = stage_table(scan_csv_tree(spark, root), "csv-report")
    good = report.where(F.col("error").isNull()).groupBy(F.sha2("header", 256).alias("print")).agg(
        F.first("header").alias("header"), F.count(F.lit(1)).alias("files"), F.collect_list("path").alias("paths"))
    groups = []
    for g in sorted(good.collect(), key=lambda r: (r["header"], r["print"])):  # one row per header
        names = _unique(next(csv.reader([g["header"].lstrip("\ufeff")])))
        kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        df = spark.read.schema(kind).option("header", True).option("enforceSchema", True).csv(sorted(unquote(p) for p in g["paths"])) \
            .select("*", F.col("_metadata.file_path").alias("_file"))
        cell = null_tokens_to_null if map_null_tokens else (lambda c: c)
        df = df.select(*[cell(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)], "_file")
        groups.append(CsvGroup(names, g["files"], normalise_columns(df)))
    return groups, report


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Default sink: Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
