"""Scoring of tables and request streams.

Everything here is a row-wise projection plus joins to small parameter
tables, so the same functions accept a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.functions.numeric import fixed_logits, round_half_even, softmax
from agrolith.functions.text import iso_time
from agrolith.operators.encode import encode
from agrolith.operators.scale import Scaler

# Request defaults filled in when a field is absent.
REQUEST_DEFAULTS = {
    "country": "Afghanistan", "crop": "Maize", "year": 2024, "rainfall": 1000.0,
    "temperature": 25.0, "pesticides": 100.0, "model_type": "svr",
}
# Model names, confidences and notes per requested model type.
MODEL_INFO = {
    "svr": ("SVR RBF Tuned", 0.94, ["SVR focusing on historical climate-pesticide correlations."]),
    "cnn": ("SatelliteCNN", 0.88, ["CNN extracting spatial health features from satellite imagery."]),
    "hybrid": ("Hybrid (0.7 SVR + 0.3 CNN)", 0.96,
               ["Hybrid model reduces variance by fusing tabular and visual signals."]),
}
UNKNOWN_MODEL = ("Unknown", 0.90)
NO_IMAGE_ERROR = "CNN model requires an image upload"
TABULAR_WEIGHT, IMAGE_WEIGHT, NO_IMAGE_FACTOR = 0.7, 0.3, 0.95
YEAR_RANGE = (1990, 2030)
IMAGE_SCALE = 60.0


def linear_scores(df: DataFrame, scaler: Scaler, models: Mapping[str, Mapping[str, float]], intercept: Column) -> DataFrame:
    """M9 for several weight sets at once: the features are scaled a single time, one column per set."""
    raw = {c: f"_raw_{c}" for c in scaler.cols}
    scaled = scaler.transform(df.withColumns({r: F.col(c) for c, r in raw.items()}))
    cols = {}
    for name, weights in models.items():
        expr = intercept
        for c, w in weights.items():
            expr = expr + F.col(c) * F.lit(float(w))
        cols[name] = expr
    return scaled.withColumns(cols).withColumns({c: F.col(r) for c, r in raw.items()}).drop(*raw.values())


def linear_score(df: DataFrame, scaler: Scaler, weights: Mapping[str, float], intercept: Column | float,
                 out: str = "pred") -> DataFrame:
    """M9: scale with a fitted scaler, then ``intercept + sum(w * z)`` in feature order."""
    scaled = scaler.transform(df.select("*", *[F.col(c).alias(f"_raw_{c}") for c in scaler.cols]))
    expr = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    for c, w in weights.items():
        expr = expr + F.col(c) * F.lit(float(w))
    res = scaled.withColumn(out, expr)
    # restore unscaled feature values
    for c in scaler.cols:
        res = res.withColumn(c, F.col(f"_raw_{c}")).drop(f"_raw_{c}")
    return res


def fill_request_defaults(req: DataFrame, defaults: Mapping[str, object] = REQUEST_DEFAULTS) -> DataFrame:
    """Absent fields get their defaults; types are cast; model type lower-cased."""
    types = {"country": "string", "crop": "string", "year": "int", "rainfall": "double",
             "temperature": "double", "pesticides": "double", "model_type": "string"}
    cols = {}
    for k, t in types.items():
        cols[k] = F.coalesce(F.col(k).cast(t), F.lit(defaults[k]).cast(t))
    cols["model_type"] = F.lower(cols["model_type"])
    return req.withColumns(cols)


def validate_requests(req: DataFrame, countries: Sequence[str] | None = None,
                      crops: Sequence[str] | None = None, year_range=YEAR_RANGE) -> DataFrame:
    """``valid`` and the first failing ``reason`` (form rules, before defaults)."""
    need = ["country", "crop", "year", "rainfall", "temperature", "pesticides"]
    missing = None
    for c in need:
        m = F.col(c).isNull()
        missing = m if missing is None else missing | m
    mt = F.lower(F.coalesce(F.col("model_type"), F.lit(REQUEST_DEFAULTS["model_type"])))
    reason = F.when(missing, F.lit("missing_fields")) \
        .when(mt.isin("cnn", "hybrid") & F.col("image_id").isNull(), F.lit("image_required")) \
        .when(~F.col("year").between(year_range[0], year_range[1]), F.lit("year_out_of_range"))
    if countries is not None:
        reason = reason.when(~F.col("country").isin(list(countries)), F.lit("country_not_listed"))
    if crops is not None:
        reason = reason.when(~F.col("crop").isin(list(crops)), F.lit("crop_not_listed"))
    return req.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted requests, and the rejected ones with their reason."""
    return validated.where("valid").drop("reason", "valid"), validated.where(~F.col("valid")).drop("valid")


def image_class_score(embedding: Column, classes: int = 2) -> Column:
    """G3 with a fixed head over the whole vector: P(class 0) from a softmax, x 60, 4 places."""
    return round_half_even(F.element_at(softmax(fixed_logits(embedding, classes)), 1) * F.lit(IMAGE_SCALE), 4)


def fuse(tabular: Column, image: Column) -> Column:
    """0.7 tabular + 0.3 image; without an image the image part is 0.95 x tabular."""
    img = F.coalesce(image, tabular * F.lit(NO_IMAGE_FACTOR))
    return tabular * F.lit(TABULAR_WEIGHT) + img * F.lit(IMAGE_WEIGHT)


def respond(scored: DataFrame, tab: str = "tabular", img: str = "image") -> DataFrame:
    """Choose the score by model type; name, confidence, notes, error."""
    mt = F.col("model_type")
    t, i = F.col(tab), F.col(img)
    hybrid = fuse(t, i)
    pred = (F.when(mt == "svr", t).when(mt == "cnn", i).when(mt == "hybrid", hybrid).otherwise(F.lit(0.0)))
    err = F.when((mt == "cnn") & i.isNull(), F.lit(NO_IMAGE_ERROR))
    name = F.lit(UNKNOWN_MODEL[0])
    conf = F.lit(UNKNOWN_MODEL[1])
    for k, (nm, cf, _) in MODEL_INFO.items():
        name = F.when(mt == k, F.lit(nm)).otherwise(name)
        conf = F.when(mt == k, F.lit(cf)).otherwise(conf)
    comp = F.coalesce(i, t * F.lit(NO_IMAGE_FACTOR))
    notes = (F.when(mt == "svr", F.array(*[F.lit(x) for x in MODEL_INFO["svr"][2]]))
             .when(mt == "cnn", F.array(*[F.lit(x) for x in MODEL_INFO["cnn"][2]]))
             .when(mt == "hybrid", F.array(F.lit(MODEL_INFO["hybrid"][2][0]),
                                           F.concat(F.lit("SVR Component: "), round_half_even(t, 2).cast("string"), F.lit(" t/ha")),
                                           F.concat(F.lit("CNN Component: "), round_half_even(comp, 2).cast("string"), F.lit(" t/ha"))))
             .otherwise(F.array().cast("array<string>")))
    ok = err.isNull()
    return scored.withColumns({
        "prediction": F.when(ok, round_half_even(pred, 2)),
        "model": F.when(ok, name), "confidence": F.when(ok, conf),
        "insights": F.when(ok, notes), "error": err,
    })


def horizon(resp: DataFrame, years: int = 5) -> DataFrame:
    """``years`` rows from the base year with fixed low/high bounds around the score."""
    base = resp.where(F.col("error").isNull())
    e = base.select("*", F.posexplode(F.sequence(F.col("year"), F.col("year") + F.lit(years - 1))).alias("i", "y"))
    p = F.col("prediction")
    return e.select("event_id", F.col("y").cast("string").alias("horizon_year"),
                    round_half_even(p * 0.9, 2).alias("actual_low"), round_half_even(p * 1.1, 2).alias("actual_high"),
                    round_half_even(p * 0.95, 2).alias("predicted_low"), round_half_even(p * 1.05, 2).alias("predicted_high"))


def response_struct(resp: DataFrame) -> DataFrame:
    """Nested response per request (struct with arrays), timestamped.

    The chart rows carry the fixed low / high bounds of X16 instead of random draws.
    """
    p = F.col("prediction")
    chart = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
        (F.col("year") + i).cast("string").alias("year"),
        round_half_even(p * 0.9, 2).alias("actual_low"), round_half_even(p * 1.1, 2).alias("actual_high"),
        round_half_even(p * 0.95, 2).alias("predicted_low"), round_half_even(p * 1.05, 2).alias("predicted_high")))
    return resp.select("event_id", F.struct(
        F.col("prediction"), F.col("model"), F.col("confidence"), F.col("insights"),
        F.when(F.col("error").isNull(), chart).alias("chart_data"),
        F.current_timestamp().alias("timestamp"),
        iso_time(F.current_timestamp()).alias("timestamp_iso"),
        F.col("error")).alias("response"))


def encode_request(req: DataFrame, dictionary: DataFrame) -> DataFrame:
    """E2 on requests: country / crop codes, unseen -> 0."""
    return encode(req, dictionary, {"country": "country_code", "crop": "crop_code"})


def score_request_table(req: DataFrame, dictionary: DataFrame, scaler: Scaler, weights: Mapping[str, float],
                        intercept: DataFrame, image_scores: DataFrame | None) -> DataFrame:
    """N13 -> E2 -> M9 -> image join -> table with ``tabular`` and ``image`` (batch or stream).

    ``intercept`` is a one-row table with column ``_ybar``; ``image_scores`` has
    ``image_id, image``. Both side tables are static, so a streaming ``req``
    joins them as stream-static joins.
    """
    r = fill_request_defaults(req)
    enc = encode_request(r, dictionary)
    feats = enc.select("event_id", "model_type", "year", "image_id", "country_code", "crop_code",
                       F.col("rainfall").alias("rain"), F.col("temperature").alias("temp"),
                       F.col("pesticides").alias("pest"))
    tab = linear_score(feats.crossJoin(intercept), scaler, weights, F.col("_ybar"), out="tabular").drop("_ybar")
    if image_scores is None:
        return tab.withColumn("image", F.lit(None).cast("double"))
    return tab.join(image_scores, "image_id", "left")
