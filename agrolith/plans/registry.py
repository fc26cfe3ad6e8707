"""Registered queries over the driver tables and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame``; each SQL twin runs on DuckDB
with the driver tables registered as views. Integers leave as BIGINT and
measures as DOUBLE on both sides; measures computed from sums of inexact
doubles are rounded half-even to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Twins that read what a query has stored: the SQL is made from the session, whose folder it lies in.
ORACLE_LATER: dict[str, Callable[[SparkSession], str]] = {}


def normalise_types(df: DataFrame) -> DataFrame:
    """Integral -> bigint, float -> double, so both engines agree on the schema."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, later: Callable[[SparkSession], str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise_types(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if later is not None:
            ORACLE_LATER[name] = later
        return fn
    return deco


def oracle() -> dict[str, str]:
    """All twins; those that read stored tables only when a session is there to say where."""
    spark = SparkSession.getActiveSession()
    return dict(ORACLE) | ({name: make(spark) for name, make in ORACLE_LATER.items()} if spark else {})


def load_all() -> None:
    """Import the query modules (they register themselves)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"agrolith.plans.{m}")


MODULES = ["q_integrate", "q_prepare", "q_profile", "q_model", "q_score", "q_learn", "q_rest"]
