"""Projection, naming, typing and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.functions.numeric import round_half_even
from agrolith.functions.text import normalise_name, strip_all

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Names tried, in order and in any case, when guessing the target column.
TARGET_CANDIDATES = ["yield", "crop_yield", "production", "output", "value", "area_harvested", "crop_production"]
# What counts as a number in text (decimal notation, an optional exponent).
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# A whole number written with a decimal point.
WHOLE = r"^[+-]?[0-9]+\.0*$"


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip, lower, blanks to underscores, for every column name."""
    return df.toDF(*[normalise_name(c) for c in df.columns])


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep-list projection; a missing column is an error."""
    return df.select(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename to canonical names."""
    return df.withColumnsRenamed(dict(mapping))


def drop_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the columns that exist, ignore the rest."""
    return df.drop(*[c for c in cols if c in df.columns])


def split_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Numeric / categorical / datetime column lists from the schema."""
    out = {"numeric": [], "categorical": [], "datetime": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, DATETIME_TYPES):
            out["datetime"].append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out["categorical"].append(f.name)
    return out


def find_country_column(columns: Sequence[str]) -> str:
    """First column whose name contains ``area`` or ``country``."""
    for c in columns:
        if "area" in c or "country" in c:
            return c
    raise KeyError(f"no country column among {list(columns)}")


def find_target_column(columns: Sequence[str], candidates: Sequence[str] = TARGET_CANDIDATES) -> str | None:
    """First candidate present, any case."""
    lower = {c.lower(): c for c in columns}
    for cand in candidates:
        if cand.lower() in lower:
            return lower[cand.lower()]
    return None


def common_columns(frames: Mapping[str, DataFrame]) -> list[str]:
    """Columns present in every table (join-key candidates), in first-table order."""
    frames = list(frames.values())
    if not frames:
        return []
    common = set(frames[0].columns)
    for f in frames[1:]:
        common &= set(f.columns)
    return [c for c in frames[0].columns if c in common]


def strict_int(c: str):
    """Integer cast where null or malformed text is an error; a whole number may be written as ``1990.0``."""
    v = F.col(c).cast("string")
    text = strip_all(v)
    number = text.try_cast("double")
    whole = F.when(text.rlike(WHOLE), number.try_cast("int"))  # only looked at when the text is no plain integer
    error = F.raise_error(F.concat(F.lit(f"bad integer in {c}: "), F.coalesce(v, F.lit("null")))).cast("int")
    return F.coalesce(text.try_cast("int"), whole, error)


def coerce_double(c: str):
    """To double; missing-value tokens and text that is not a decimal number become null (never NaN)."""
    text = strip_all(F.col(c).cast("string"))
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def hg_to_tonnes(df: DataFrame, src: str = "yield_hg_per_ha", dst: str = "yield_tonnes_per_ha") -> DataFrame:
    """hg/ha x 0.0001 -> t/ha, 4 places half-even, drop the source."""
    return df.withColumn(dst, round_half_even(F.col(src) * F.lit(0.0001), 4)).drop(src)


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Range, mean and sample std of the target (one row)."""
    y = F.col(target)
    return df.agg(F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"),
                  F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows with a null in ``subset``."""
    return df.na.drop(subset=list(subset))


def year_at_least(df: DataFrame, year_col: str, first_year: int) -> DataFrame:
    """threshold filter on an integer year."""
    return df.where(F.col(year_col) >= F.lit(first_year))


def require_tables(frames: Mapping[str, DataFrame], required: Sequence[str]) -> None:
    """fail early when a required table is absent."""
    missing = [k for k in required if k not in frames]
    if missing:
        raise RuntimeError(f"required tables not loaded: {missing}")
