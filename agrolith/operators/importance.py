"""Permutation importance (M13) over the whole table.

Every row gets its rank in md5 order; a keyed bijection of the ranks names the
row whose value of a feature it borrows in a repeat, so each repeat is one
permutation of all rows, the same one for any number of partitions. One shuffle
join brings a row and its partners together. A score depends on the features
alone, so rows that show the same ones in a repeat are counted first (with mean
and spread of the target), and each distinct row of features is scored once.
Importance is the drop in R^2 against the unpermuted score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.hashing import hash_order
from agrolith.functions.numeric import round_half_even
from agrolith.operators.rank import global_rank, with_permuted
from agrolith.session import stage_table


def permutation_importance(df: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                           y: str, key_cols, repeats: int = 5, seed: int = 0, places: int | None = 4) -> DataFrame:
    """Long table ``(feature, repeat, importance)``; ``predict`` adds a ``pred`` column made from the features and leaves the others alone."""
    features = list(features)
    ranked = global_rank(df.withColumn("_order", hash_order(seed + 1, key_cols)), ["_order", *features, y], "_rank").drop("_order")
    n = ranked.count()
    turns = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")) if repeats else ranked.withColumn("repeat", F.lit(0)).limit(0)
    turns = with_permuted(turns, "_rank", n, F.concat(F.lit(f"{seed}|"), F.col("repeat").cast("string")), "_to")
    mates = ranked.select(F.col("_rank").alias("_to"), F.struct(*features).alias("_mate"))
    rows = turns.select(*df.columns, "repeat", "_to").join(mates, "_to")
    # variant 0 has the row's own features, variant i those with feature i borrowed
    shown = [F.struct(F.lit(i).alias("_v"), *[(F.col("_mate")[c] if c == f else F.col(c)).alias(c) for c in features]) for i, f in enumerate([None, *features])]
    rows = rows.select("repeat", F.col(y).alias("_y"), F.explode(F.array(*shown)).alias("_s")).select("repeat", "_y", "_s.*")
    same = rows.groupBy("repeat", "_v", *features).agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_mean"), (F.var_pop("_y") * F.count("_y")).alias("_spread"))
    e = F.col("_mean") - F.col("pred")
    errors = predict(same).groupBy("repeat").pivot("_v", list(range(len(features) + 1))).agg(F.sum(F.col("_spread") + F.col("_n") * e * e))
    whole = ranked.agg((F.var_pop(y) * F.count(F.lit(1))).alias("_whole"))  # one row
    scores = errors.crossJoin(whole).select("repeat", *[
        (F.lit(1.0) - F.col(str(i)) / F.col("_whole")).alias("_base" if i == 0 else f"_r2_{i - 1}") for i in range(len(features) + 1)])
    drops = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("_base") - F.col(f"_r2_{i}")).alias("importance")) for i, f in enumerate(features)])
    out = scores.select("repeat", F.explode(drops).alias("_d")).select("_d.feature", "repeat", "_d.importance")
    if places is not None:
        out = out.withColumn("importance", round_half_even("importance", places))
    return stage_table(out, "importance")  # a row per feature and repeat


def importance_summary(imp: DataFrame) -> DataFrame:
    """Mean and std of importance per feature, ranked by mean (one row per feature)."""
    s = imp.groupBy("feature").agg(round_half_even(F.avg("importance"), 4).alias("mean_importance"),
                                   round_half_even(F.stddev_pop("importance"), 4).alias("std_importance"))
    # one row per feature: a global window over a table bounded by the feature count
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_importance"), "feature")))
