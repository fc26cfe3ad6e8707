import numbers

import duckdb
import pandas as pd

import __spark_entry__ as E
from agrolith.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["integrate_full", "join_left_audit", "group_median_fill", "clean_text_numbers", "impute_median",
        "label_encode", "hash_split", "sample_n", "describe_numeric", "regression_metrics", "cv_pivot",
        "permutation_importance", "score_requests", "class_accuracy_loss", "insight_topics", "number_forms",
        "column_roles", "svr_eval_linear", "svr_eval_poly", "svr_eval_rbf", "grid_eval", "modality_compare",
        "accepted_requests", "rejected_requests", "response_rows", "csv_round_trip", "landed_tables", "residual_by_fitted"]


def test_stage_tables_follow_their_input(spark, tmpdir_path):
    """A changed input folder gives new stage tables."""
    from agrolith.plans.stage import stage
    d = f"{tmpdir_path}/in"
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{d}/t.parquet")
        assert stage(spark, d, "t", lambda: spark.read.parquet(f"{d}/t.parquet")).count() == n


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["country", "crop", "year", "average_rain_fall_mm_per_year", "avg_temp",
                          "pesticides_tonnes", "yield_tonnes_per_ha"]


def test_registry_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 55


def _cell(v):
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return None if v != v else float(v)
    return None if v is pd.NA or v is pd.NaT else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(map(_cell, r)) for r in pdf[cols].itertuples(index=False)), key=repr)


def test_oracle_matches_on_small_data(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in FAST:
        s = q[name](spark, SF).toPandas()
        d = con.execute(o[name]).df()
        assert sorted(s.columns) == sorted(d.columns), name
        assert _rows(s) == _rows(d), name
