"""Repeatable per-row choice from a hash of (seed, key).

The same value is computable in any SQL engine with md5, so splits, folds and
samples can be checked by a second engine, and membership does not depend on
partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(cols) -> Column:
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def hash_u32(seed: int, key_cols) -> Column:
    """First 32 bits of md5(seed || '|' || key) as a non-negative bigint."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), _key(key_cols)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(seed: int, key_cols, buckets: int = 1000) -> Column:
    """Bucket in [0, buckets) from the md5 prefix."""
    return F.pmod(hash_u32(seed, key_cols), F.lit(buckets)).cast("int")


def hash_order(seed: int, key_cols) -> Column:
    """Full md5 text, a total order for repeatable sampling."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _key(key_cols)))


def sql_hash_u32(seed: int, key_sql: str) -> str:
    """DuckDB twin of :func:`hash_u32` for a single key expression."""
    return f"(('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8))::UBIGINT)"
