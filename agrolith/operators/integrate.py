"""Integration of keyed sources (J1-J6, A1, A2) and the full job.

All joins are null-safe left joins on the shared keys. Side tables are
aggregated before the join (one row per key travels); the planner broadcasts a
side only when its bytes are under the session's threshold. The joined table is
staged once, and the fill reads it from there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.functions.numeric import round_half_even
from agrolith.functions.text import strip_all, title_case
from agrolith.operators import clean as C
from agrolith.operators.impute import group_median_fill
from agrolith.operators.quantile import _ns_join
from agrolith.session import stage_table

KEYS = ["country", "year"]


# ---- source clean-up -------------------------------------------------------

def clean_base(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Base table: keep area, item, year, value (+ extra), rename, drop null value.

    The country text is kept as it is (not stripped) before the join.
    """
    df = C.normalise_columns(raw)
    df = C.keep(df, ["area", "item", "year", "value", *extra])
    df = C.rename(df, {"area": "country", "item": "crop", "value": "yield_hg_per_ha"})
    df = df.withColumn("yield_hg_per_ha", C.coerce_double("yield_hg_per_ha"))
    df = C.drop_missing(df, ["yield_hg_per_ha"])
    return df.withColumn("year", C.strict_int("year"))


def clean_rainfall(raw: DataFrame, value: str = "average_rain_fall_mm_per_year") -> DataFrame:
    """Rainfall: find the country column, strip it, coerce the reading; keys may repeat."""
    df = C.normalise_columns(raw)
    cc = C.find_country_column(df.columns)
    return df.select(strip_all(cc).alias("country"), C.strict_int("year").alias("year"),
                     C.coerce_double(value).alias(value))


def clean_temperature(raw: DataFrame, first_year: int = 1960, value: str = "avg_temp") -> DataFrame:
    """Temperature: strip, threshold on year, mean per key to 4 places (A1)."""
    df = C.normalise_columns(raw)
    df = df.select(strip_all("country").alias("country"), C.strict_int("year").alias("year"),
                   C.coerce_double(value).alias(value))
    df = C.year_at_least(df, "year", first_year)
    return group_mean(df, KEYS, value, places=4)


def clean_pesticides(raw: DataFrame, value: str = "pesticides_tonnes") -> DataFrame:
    """Pesticides: strip, rename, sum per key; an all-null key sums to 0 (A2)."""
    df = C.normalise_columns(raw)
    df = df.select(strip_all("area").alias("country"), C.strict_int("year").alias("year"),
                   C.coerce_double("value").alias(value))
    return group_sum_zero(df, KEYS, value)


# ---- aggregates --------------------------------------------------------------

def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def group_mean(df: DataFrame, keys: Sequence[str], value: str, places: int | None = 4) -> DataFrame:
    """A1: mean per key, null keys dropped, rounded half-even."""
    m = F.avg(value)
    out = _drop_null_keys(df, keys).groupBy(*keys).agg(m.alias(value))
    if places is not None:
        out = out.withColumn(value, round_half_even(value, places))
    return out


def group_sum_zero(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A2: sum per key, null keys dropped; an all-null group gives 0."""
    return _drop_null_keys(df, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


# ---- joins -------------------------------------------------------------------

def left_join(base: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join on null-safe keys; the right side is not deduplicated."""
    return _ns_join(base, right, list(keys), "left")


def key_counts(df: DataFrame, keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """Rows per key (or the sum of ``weight``) as ``_w``."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys).agg(rows.cast("long").alias("_w"))


def join_audit(base: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, name: str = "join",
               strip_col: str | None = "country", weight: str | None = None,
               right_weight: str | None = None) -> DataFrame:
    """One row describing a left join without materialising it.

    Both sides are reduced to a count per key, so every number comes from the
    join of the counts. ``weight`` and ``right_weight`` name columns that
    already count rows per key.
    """
    keys = list(keys)
    bk = key_counts(base, keys, weight)
    rk = key_counts(right, keys, right_weight).withColumnRenamed("_w", "_rc")
    j = _ns_join(bk, rk, keys, "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    audit = j.agg(zero(F.col("_w")).alias("base_rows"), zero(F.when(F.col("_rc").isNotNull(), F.col("_w"))).alias("matched_rows"),
                  zero(F.when(F.col("_rc").isNull(), F.col("_w"))).alias("unmatched_rows"),
                  zero(F.col("_w") * F.coalesce("_rc", F.lit(1))).alias("out_rows")) \
        .withColumn("fanout_rows", F.col("out_rows") - F.col("base_rows"))
    dup = rk.agg(F.count_if(F.col("_rc") > 1).alias("dup_right_keys"),
                 F.count(F.lit(1)).alias("right_keys"))
    audit = audit.crossJoin(dup)  # two one-row tables
    if strip_col and strip_col in keys:
        skeys = [strip_all(k).alias(k) if k == strip_col else F.col(k) for k in keys]
        stripped = _ns_join(bk.select(*skeys, "_w"), rk.select(*keys), keys, "left_semi")
        audit = audit.crossJoin(stripped.agg(zero(F.col("_w")).alias("matched_if_stripped")))
    return audit.select(F.lit(name).alias("join_name"), "*")


def join_chain_audit(base: DataFrame, sides: Mapping[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Each left join of a chain audited against the table it extends.

    The base is read once, for its rows per key; a join only multiplies the
    count of a key by the rows it meets.
    """
    keys = list(keys)
    counts = stage_table(key_counts(base, keys), "key-counts")
    out = None
    for name, side in sides.items():
        rk = stage_table(key_counts(side, keys), "key-counts")
        row = join_audit(counts, rk, keys, name, weight="_w", right_weight="_w")
        out = row if out is None else out.unionByName(row)
        met = _ns_join(counts, rk.withColumnRenamed("_w", "_rc"), keys, "left")
        counts = met.select(*keys, (F.col("_w") * F.coalesce("_rc", F.lit(1))).alias("_w"))
    return out


def join_type_counts(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows kept by inner, left, right and full outer joins (long form).

    Both sides are reduced to a count per key, then one full outer join of the
    counts gives all four numbers; no pair of rows is ever formed.
    """
    keys = list(keys)
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lc"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rc"))
    r = rc
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = lc[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    j = lc.join(r, cond, "full_outer")
    both = F.sum(F.when(F.col("_lc").isNotNull() & F.col("_rc").isNotNull(), F.col("_lc") * F.col("_rc")))
    lonly = F.sum(F.when(F.col("_rc").isNull(), F.col("_lc")))
    ronly = F.sum(F.when(F.col("_lc").isNull(), F.col("_rc")))
    t = j.agg(F.coalesce(both, F.lit(0)).alias("i"), F.coalesce(lonly, F.lit(0)).alias("l"),
              F.coalesce(ronly, F.lit(0)).alias("r"))
    rows = F.array(
        F.struct(F.lit("inner").alias("join_type"), F.col("i").alias("rows")),
        F.struct(F.lit("left").alias("join_type"), (F.col("i") + F.col("l")).alias("rows")),
        F.struct(F.lit("right").alias("join_type"), (F.col("i") + F.col("r")).alias("rows")),
        F.struct(F.lit("outer").alias("join_type"), (F.col("i") + F.col("l") + F.col("r")).alias("rows")))
    return t.select(F.explode(rows).alias("x")).select("x.join_type", F.col("x.rows").cast("long").alias("rows"))


# ---- the full job ------------------------------------------------------------

# The measures that are filled after the joins.
FILL_COLUMNS = ["average_rain_fall_mm_per_year", "avg_temp", "pesticides_tonnes"]


def merge_sources(frames: Mapping[str, DataFrame], first_temp_year: int = 1960,
                  base_extra: Sequence[str] = ()) -> DataFrame:
    """Clean each source and left-join the three side tables onto the base."""
    C.require_tables(frames, ["yield", "rainfall", "temp", "pesticides"])
    base = clean_base(frames["yield"], base_extra)
    # staged: the planner knows their bytes, so few keys do not deal the base out to few tasks
    rain = stage_table(clean_rainfall(frames["rainfall"]), "side")
    temp = stage_table(clean_temperature(frames["temp"], first_temp_year), "side")
    pest = stage_table(clean_pesticides(frames["pesticides"]), "side")
    merged = left_join(base, rain)
    merged = left_join(merged, temp)
    return left_join(merged, pest)


def post_merge_fill(merged: DataFrame, group_col: str = "crop",
                    cols: Sequence[str] = FILL_COLUMNS, target: str = "yield_hg_per_ha") -> DataFrame:
    """I4 + F1: group-median fill, then global-median fallback, then drop missing target."""
    cols = [c for c in cols if c in merged.columns]
    filled = group_median_fill(merged, cols, group_col)
    return C.drop_missing(filled, [target])


def finalise(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Types, title case, unit conversion; column order of the integrated table."""
    df = df.withColumns({"country": title_case("country"), "crop": title_case("crop")})
    df = C.hg_to_tonnes(df)
    return df.select("country", "crop", "year", *FILL_COLUMNS, "yield_tonnes_per_ha", *extra)


def integrate(frames: Mapping[str, DataFrame], first_temp_year: int = 1960,
              adjust=None, extra: Sequence[str] = ()) -> DataFrame:
    """Clean x4 -> join x3 -> (optional ``adjust``) -> fill -> finalise.

    The joined table is written once and the two median runs and the fill read
    it; the medians run while this function builds the result.
    """
    merged = merge_sources(frames, first_temp_year, extra)
    if adjust is not None:
        merged = adjust(merged)
    return finalise(post_merge_fill(stage_table(merged, "joined")), extra)
