"""Landing (S8): each raw source becomes a Parquet table in a standard layout.

Tables that are already there are left as they are (``mode("ignore")``), the
re-aimed form of "skip files already copied".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def land_tables(frames: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    out = {}
    for name, df in frames.items():
        path = f"{root.rstrip('/')}/raw/{name}"
        df.write.mode("ignore").parquet(path)
        out[name] = path
    return out
