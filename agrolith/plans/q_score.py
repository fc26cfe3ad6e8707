"""Registered queries: batch scoring, fusion, request handling, topics.

Requests are derived from ``events`` (one request per event): country from
the user, crop from a fixed list (one name the dictionary lacks), year and
image id from the JSON ``props``, and some fields left empty by event type so
the defaults and the form rules have work to do. Image scores come from the
whole ``embeddings`` vectors with a fixed linear head.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.numeric import fixed_logits_sql, round_half_even
from agrolith.functions.topics import insight_topic, insight_topic_sql
from agrolith.operators import score as SCR
from agrolith.operators.score import linear_score
from agrolith.plans import stage as ST
from agrolith.plans import tables as TB
from agrolith.plans.q_model import FIXED_MODELS, MF, SQL_PRED, _pred_sql, fixed_scaler, train_mean
from agrolith.plans.registry import register

# Crop names a request may carry (the last is absent from the dictionary).
REQUEST_CROPS = ["Economy", "Large", "Medium", "Promo", "Small", "Standard", "Maize"]
# Requested model type per event type.
MODEL_BY_EVENT = {"view": "svr", "click": "hybrid", "purchase": "cnn", "signup": "HYBRID", "error": "tree"}


def requests_table(spark, d):
    ev = TB.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    et = F.col("event_type")
    none = F.lit(None)
    crops = F.array(*[F.lit(c) for c in REQUEST_CROPS])
    mt = F.lit(None).cast("string")
    for e, m in MODEL_BY_EVENT.items():
        mt = F.when(et == e, F.lit(m)).otherwise(mt)
    return ev.select(
        "event_id",
        F.when(et == "error", none).otherwise(F.concat(F.lit("Nation_"), F.pmod("user_id", F.lit(30)).cast("string"))).alias("country"),
        F.when(et == "signup", none).otherwise(F.element_at(crops, (F.pmod("user_id", F.lit(7)) + 1).cast("int"))).alias("crop"),
        F.when(et == "view", none).otherwise(F.lit(1985) + F.pmod(k, F.lit(50))).cast("int").alias("year"),
        F.when(et == "purchase", none).otherwise(F.col("value") * 10).cast("double").alias("rainfall"),
        (F.col("value") / 10).alias("temperature"),
        F.when(F.pmod("user_id", F.lit(11)) == 0, none).otherwise(F.col("value")).cast("double").alias("pesticides"),
        mt.alias("model_type"),
        F.when(F.pmod(k, F.lit(4)) == 0, none).otherwise(k).cast("bigint").alias("image_id"))


_CROPS_SQL = "[" + ", ".join(f"'{c}'" for c in REQUEST_CROPS) + "]"
_MT_SQL = "CASE " + " ".join(f"WHEN event_type = '{e}' THEN '{m}'" for e, m in MODEL_BY_EVENT.items()) + " END"


def _info_sql(i):
    return " ".join(f"WHEN model_type = '{k}' THEN {v[i]!r}" for k, v in SCR.MODEL_INFO.items())


SQL_REQ = f""",
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
req AS (
  SELECT event_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE 'Nation_' || CAST(user_id % 30 AS VARCHAR) END AS country,
    CASE WHEN event_type = 'signup' THEN NULL ELSE {_CROPS_SQL}[user_id % 7 + 1] END AS crop,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(1985 + k % 50 AS INTEGER) END AS year,
    CASE WHEN event_type = 'purchase' THEN NULL ELSE value * 10 END AS rainfall,
    value / 10 AS temperature,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE value END AS pesticides,
    {_MT_SQL} AS model_type,
    CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS image_id
  FROM ev),
rq AS (
  SELECT event_id, coalesce(country, 'Afghanistan') AS country, coalesce(crop, 'Maize') AS crop,
         coalesce(year, 2024) AS year, coalesce(rainfall, 1000.0) AS rain, coalesce(temperature, 25.0) AS temp,
         coalesce(pesticides, 100.0) AS pest, lower(coalesce(model_type, 'svr')) AS model_type, image_id FROM req),
dict AS (
  SELECT 'country' AS column, country AS value, dense_rank() OVER (ORDER BY country) - 1 AS code FROM (SELECT DISTINCT country FROM final)
  UNION ALL SELECT 'crop', crop, dense_rank() OVER (ORDER BY crop) - 1 FROM (SELECT DISTINCT crop FROM final)),
enc AS (
  SELECT rq.*, coalesce(dc.code, 0) AS country_code, coalesce(dp.code, 0) AS crop_code FROM rq
  LEFT JOIN dict dc ON dc.column = 'country' AND dc.value = rq.country
  LEFT JOIN dict dp ON dp.column = 'crop' AND dp.value = rq.crop),
lgt AS (SELECT vec_id, {fixed_logits_sql('embedding', 2)} AS lg FROM embeddings),
emb AS (SELECT vec_id, lg[1] AS e1, lg[2] AS e2 FROM lgt),
img AS (SELECT vec_id, round_even((exp(e1 - greatest(e1, e2)) / (exp(e1 - greatest(e1, e2)) + exp(e2 - greatest(e1, e2)))) * 60.0 * 1e4, 0) / 1e4 AS image FROM emb),
sc AS (
  SELECT m.event_id, m.model_type, m.year, {_pred_sql(FIXED_MODELS['fixed_a'])} AS tabular, img.image
  FROM enc m CROSS JOIN st LEFT JOIN img ON img.vec_id = m.image_id),
fu AS (SELECT *, tabular * 0.7 + coalesce(image, tabular * 0.95) * 0.3 AS fused FROM sc),
resp AS (
  SELECT event_id, model_type, year,
    CASE WHEN model_type = 'cnn' AND image IS NULL THEN NULL ELSE
      round_even((CASE WHEN model_type = 'svr' THEN tabular WHEN model_type = 'cnn' THEN image
                       WHEN model_type = 'hybrid' THEN fused ELSE 0.0 END) * 100, 0) / 100 END AS prediction,
    CASE WHEN model_type = 'cnn' AND image IS NULL THEN NULL {_info_sql(0)} ELSE '{SCR.UNKNOWN_MODEL[0]}' END AS model,
    CAST(CASE WHEN model_type = 'cnn' AND image IS NULL THEN NULL {_info_sql(1)} ELSE {SCR.UNKNOWN_MODEL[1]} END AS DOUBLE) AS confidence,
    CASE WHEN model_type = 'cnn' AND image IS NULL THEN '{SCR.NO_IMAGE_ERROR}' END AS error,
    CASE WHEN model_type = 'cnn' AND image IS NULL THEN NULL
         WHEN model_type = 'svr' THEN '{SCR.MODEL_INFO["svr"][2][0]}' WHEN model_type = 'cnn' THEN '{SCR.MODEL_INFO["cnn"][2][0]}'
         WHEN model_type = 'hybrid' THEN '{SCR.MODEL_INFO["hybrid"][2][0]} | SVR Component: '
              || CAST(round_even(tabular * 100, 0) / 100 AS VARCHAR) || ' t/ha | CNN Component: '
              || CAST(round_even(coalesce(image, tabular * 0.95) * 100, 0) / 100 AS VARCHAR) || ' t/ha'
         ELSE '' END AS insights
  FROM fu)
"""
SQL_ALL = MF + SQL_PRED.split(",\nlp AS")[0] + SQL_REQ


def image_scores(spark, d):
    return TB.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), SCR.image_class_score(F.col("embedding")).alias("image"))


def scored_requests(spark, d, req=None):
    """N13 -> E2 -> M9 (+ image scores) -> table with tabular and image score."""
    mf = ST.model_frame(spark, d)
    req = requests_table(spark, d) if req is None else req
    return SCR.score_request_table(req, ST.dictionary(spark, d), fixed_scaler(mf), FIXED_MODELS["fixed_a"],
                                   train_mean(mf), image_scores(spark, d))


@register("score_linear", MF + SQL_PRED.split(",\nlp AS")[0] +
          f"\nSELECT m.order_key, m.crop, m.y, round_even({_pred_sql(FIXED_MODELS['fixed_a'])} * 1e4, 0) / 1e4 AS pred FROM mf m, st")
def score_linear(spark, d):
    """M9: batch scoring of every row with a stored scaler + weight set."""
    mf = ST.model_frame(spark, d)
    out = linear_score(mf.crossJoin(train_mean(mf)), fixed_scaler(mf), FIXED_MODELS["fixed_a"], F.col("_ybar"))
    return out.select("order_key", "crop", "y", round_half_even("pred", 4).alias("pred"))


@register("fuse_scores", SQL_ALL + """
SELECT event_id, round_even(tabular * 1e4, 0) / 1e4 AS tabular, image, round_even(fused * 1e4, 0) / 1e4 AS fused FROM fu""")
def fuse_scores(spark, d):
    """0.7 tabular + 0.3 image score per request (image missing -> M11 rule)."""
    s = scored_requests(spark, d)
    return s.select("event_id", round_half_even("tabular", 4).alias("tabular"), "image",
                    round_half_even(SCR.fuse(F.col("tabular"), F.col("image")), 4).alias("fused"))


@register("fuse_no_image", SQL_ALL + """
SELECT event_id, round_even(tabular * 1e4, 0) / 1e4 AS tabular, round_even(fused * 1e4, 0) / 1e4 AS fused FROM fu WHERE image IS NULL""")
def fuse_no_image(spark, d):
    """Requests without an image: image part = 0.95 x tabular (fused = 0.985 x tabular)."""
    s = scored_requests(spark, d).where(F.col("image").isNull())
    return s.select("event_id", round_half_even("tabular", 4).alias("tabular"),
                    round_half_even(SCR.fuse(F.col("tabular"), F.col("image")), 4).alias("fused"))


@register("score_requests", SQL_ALL + "SELECT event_id, model_type, prediction, model, confidence, error, insights FROM resp")
def score_requests(spark, d):
    """Defaults, encoding, model switch, name, confidence, notes, error rows."""
    r = SCR.respond(scored_requests(spark, d))
    return r.select("event_id", "model_type", "prediction", "model", "confidence", "error",
                    F.array_join("insights", " | ").alias("insights"))


@register("request_validation", SQL_ALL + """
SELECT event_id,
  CASE WHEN country IS NULL OR crop IS NULL OR year IS NULL OR rainfall IS NULL OR temperature IS NULL OR pesticides IS NULL
       THEN 'missing_fields'
       WHEN lower(coalesce(model_type, 'svr')) IN ('cnn', 'hybrid') AND image_id IS NULL THEN 'image_required'
       WHEN NOT (year BETWEEN 1990 AND 2030) THEN 'year_out_of_range' END AS reason,
  (CASE WHEN country IS NULL OR crop IS NULL OR year IS NULL OR rainfall IS NULL OR temperature IS NULL OR pesticides IS NULL
       THEN 'missing_fields'
       WHEN lower(coalesce(model_type, 'svr')) IN ('cnn', 'hybrid') AND image_id IS NULL THEN 'image_required'
       WHEN NOT (year BETWEEN 1990 AND 2030) THEN 'year_out_of_range' END) IS NULL AS valid
FROM req""")
def request_validation(spark, d):
    """Form rules on raw requests: required fields, image for cnn/hybrid, year 1990-2030."""
    return SCR.validate_requests(requests_table(spark, d)).select("event_id", "reason", "valid")


@register("horizon_bounds", SQL_ALL + """
SELECT r.event_id, CAST(r.year + i AS VARCHAR) AS horizon_year,
  round_even(r.prediction * 0.9 * 100, 0) / 100 AS actual_low, round_even(r.prediction * 1.1 * 100, 0) / 100 AS actual_high,
  round_even(r.prediction * 0.95 * 100, 0) / 100 AS predicted_low, round_even(r.prediction * 1.05 * 100, 0) / 100 AS predicted_high
FROM resp r, range(0, 5) t(i) WHERE r.error IS NULL""")
def horizon_bounds(spark, d):
    """Five yearly rows from the request year with fixed bounds around the score."""
    return SCR.horizon(SCR.respond(scored_requests(spark, d)))


@register("insight_topics", f"SELECT doc_id, {insight_topic_sql('text')} AS topic FROM documents")
def insight_topics(spark, d):
    """First matching keyword rule gives each document its topic (whole texts)."""
    return TB.table(spark, d, "documents").select("doc_id", insight_topic("text").alias("topic"))
