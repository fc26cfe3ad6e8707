"""Ranks of whole tables and keyed permutations of them.

A rank comes from a range partitioning: rows are ordered inside their task and
numbered from the counts of the tasks before. No task sorts or holds the table,
and the ranks do not depend on the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.session import stage_table

def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of every row in the order of ``order`` (a total order, or equal rows are alike)."""
    order = list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small tables are not put in one file
    # staged: the numbers of a task belong to the rows as they were written
    rows = stage_table(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_mid", 33))
    parts = rows.groupBy("_part").agg(F.min("_mid").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    # one row per task of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start")).alias("_offset"))
    return rows.join(parts, "_part").withColumn(out, F.col("_mid") + F.col("_offset")).drop("_mid", "_part", "_offset")


def with_permuted(df: DataFrame, rank: str, n: int, key: Column, out: str, rounds: int = 4) -> DataFrame:
    """``df`` with the place a keyed bijection of [0, n) sends the column ``rank`` to; ``key`` is a string column.

    A Feistel network over the grid ceil(sqrt n) x ceil(n / ceil(sqrt n)): each
    round shifts one coordinate by a hash of the key, the round and the other
    one, modulo the grid's side. Places outside [0, n), fewer than sqrt n, are
    sent on until they are inside, which keeps it a bijection. md5 and whole
    numbers only, so any SQL engine computes the same places.
    """
    a = math.isqrt(max(0, n - 1)) + 1
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        left, right = F.floor(x / F.lit(float(b))).cast("bigint"), x % F.lit(b)
        for i in range(rounds):
            noise = lambda v, i=i: F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{i}|"), v.cast("string"))), 1, 8), 16, 10).cast("bigint")
            if i % 2 == 0:
                left = (left + noise(right)) % F.lit(a)
            else:
                right = (right + noise(left)) % F.lit(b)
        return left * F.lit(b) + right

    # a column of its own, so that the rounds run once for each row
    df = df.withColumn(out, once(F.col(rank)))
    if a * b == n:
        return df
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(a * b - n)), F.col(out), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walk))
