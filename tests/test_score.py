import pytest
from pyspark.sql import functions as F

from agrolith.operators import score as SCR
from agrolith.operators.scale import fit as fit_scaler
from agrolith.operators.encode import fit_encoders
from agrolith.streaming.requests import REQUEST_SCHEMA, request_stream, run_available_now, score_stream

REQS = [
    (1, None, None, None, None, None, None, None, None),          # all defaults
    (2, "A", "x", 2020, 900.0, 20.0, 50.0, "hybrid", None),        # hybrid, no image
    (3, "B", "y", 2020, 900.0, 20.0, 50.0, "tree", 7),             # unknown model type
    (4, "A", "x", 2031, 900.0, 20.0, 50.0, "svr", None),           # year out of range
    (5, "A", "x", 2020, 900.0, 20.0, 50.0, "CNN", None),           # cnn without image
    (6, "A", "x", 2020, 900.0, 20.0, 50.0, "cnn", 7),              # cnn with image
]


def _model(spark):
    train = spark.createDataFrame([("A", "x", 1000.0, 20.0, 50.0, 3.0), ("B", "y", 800.0, 25.0, 150.0, 5.0),
                                   ("B", "x", 1200.0, 22.0, 90.0, 4.0)],
                                  "country string, crop string, rain double, temp double, pest double, y double")
    dic = fit_encoders(train, ["country", "crop"])
    from agrolith.operators.encode import encode
    t = encode(train, dic, {"country": "country_code", "crop": "crop_code"})
    feats = ["country_code", "crop_code", "rain", "temp", "pest"]
    sc = fit_scaler(t, feats)
    ybar = t.agg(F.avg("y").alias("_ybar"))
    img = spark.createDataFrame([(7, 12.5)], "image_id bigint, image double")
    w = {"rain": 0.3, "temp": 0.2, "pest": -0.1, "country_code": 0.05, "crop_code": 0.15}
    return lambda req: SCR.score_request_table(req, dic, sc, w, ybar, img)


def test_request_rules(spark):
    req = spark.createDataFrame(REQS, REQUEST_SCHEMA)
    score = _model(spark)
    out = {r.event_id: r for r in SCR.respond(score(req)).collect()}
    assert out[1].model_type == "svr" and out[1].model == "SVR RBF Tuned" and out[1].confidence == 0.94
    assert out[2].prediction == pytest.approx(round(0.985 * out[2].tabular, 2), abs=0.011)
    assert out[3].prediction == 0.0 and out[3].model == "Unknown"
    assert out[5].error == "CNN model requires an image upload" and out[5].prediction is None
    assert out[6].prediction == 12.5 and out[6].model == "SatelliteCNN"
    v = {r.event_id: r.reason for r in SCR.validate_requests(req).collect()}
    assert v == {1: "missing_fields", 2: "image_required", 3: None, 4: "year_out_of_range",
                 5: "image_required", 6: None}
    h = SCR.horizon(SCR.respond(score(req))).where("event_id = 6").orderBy("horizon_year").collect()
    assert [r.horizon_year for r in h] == ["2020", "2021", "2022", "2023", "2024"]
    assert h[0].actual_low == 11.25 and h[0].predicted_high == 13.12
    nested = SCR.response_struct(SCR.respond(score(req))).where("event_id = 6").first().response
    assert len(nested.chart_data) == 5 and nested.insights
    assert nested.timestamp_iso[10] == "T" and len(nested.timestamp_iso) == 26


def test_stream_equals_batch(spark, tmpdir_path):
    req = spark.createDataFrame(REQS, REQUEST_SCHEMA)
    src = f"{tmpdir_path}/in"
    req.coalesce(2).write.parquet(src)
    score = _model(spark)
    out = f"{tmpdir_path}/out"
    run_available_now(score_stream(request_stream(spark, src), score), out, checkpoint=f"{tmpdir_path}/ck")
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in score_stream(req, score).collect())
    assert got == want


def test_stream_goes_on_after_a_restart(spark, tmpdir_path):
    """Requests that land after a run are scored by the next one, from another session, exactly once."""
    req = spark.createDataFrame(REQS, REQUEST_SCHEMA)
    src, out, ck = (f"{tmpdir_path}/{x}" for x in ("in", "out", "ck"))
    for session, ids in ((spark, "event_id <= 4"), (spark.newSession(), "event_id > 4")):
        req.where(ids).write.mode("append").parquet(src)
        score = _model(session)
        run_available_now(score_stream(request_stream(session, src), score), out, ck)
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3, 4, 5, 6]


def test_accepted_and_rejected(spark):
    req = spark.createDataFrame(REQS, REQUEST_SCHEMA)
    yes, no = SCR.split_requests(SCR.validate_requests(req, countries=["A"], crops=["x"]))
    assert sorted(r.event_id for r in yes.collect()) == [6] and yes.columns == req.columns
    assert {r.event_id: r.reason for r in no.collect()} == {1: "missing_fields", 2: "image_required", 3: "country_not_listed",
                                                           4: "year_out_of_range", 5: "image_required"}


def test_image_score_reads_the_whole_vector(spark):
    import math
    v = [((i * 37) % 11 - 5) / 4 for i in range(64)]
    lg = [sum(x * (((i + 1) * (j + 1)) % 7 - 3) / 8 for i, x in enumerate(v)) for j in range(2)]
    got = spark.createDataFrame([(v,)], "e array<float>").select(SCR.image_class_score(F.col("e")).alias("s")).first().s
    assert got == pytest.approx(60 / (1 + math.exp(lg[1] - lg[0])), abs=1e-4)
