"""Registered queries: string imputation, key discovery, clipping, times, request split, responses, file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agrolith.functions.numeric import clip_low
from agrolith.functions.text import file_extension, file_name, iso_time, parent_name, parent_path, relative_path
from agrolith.operators import clean as C
from agrolith.operators import metrics as M
from agrolith.operators import profile as P
from agrolith.operators import score as SCR
from agrolith.operators.impute import impute, null_counts
from agrolith.plans import tables as TB
from agrolith.plans.q_model import MF, SQL_PRED, fixed_predictions
from agrolith.plans.q_score import REQUEST_CROPS, SQL_ALL, SQL_REQ, requests_table, scored_requests
from agrolith.plans.registry import register
from agrolith.session import checkpoint_dir
from agrolith.sources.csv import load_named, read_csv_strings, read_csv_tree, write_csv
from agrolith.sources.landing import land_tables
from agrolith.streaming.requests import commit_log, request_stream, run_available_now, score_stream

_REQ = "WITH " + SQL_REQ.split(",\nrq AS")[0].lstrip().lstrip(",")
_MODE = "(SELECT {c} FROM req WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def scratch(spark, name):
    """A new folder for a file round trip, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/agrolith-files/{uuid.uuid4().hex}/{name}"


@register("impute_strings", _REQ + f"""
SELECT event_id, coalesce(country, {_MODE.format(c='country')}) AS country, coalesce(crop, {_MODE.format(c='crop')}) AS crop,
       coalesce(model_type, 'missing_value') AS model_type FROM req""")
def impute_strings(spark, d):
    """Text columns filled with the most frequent value (ties to the smallest) or a constant."""
    req = requests_table(spark, d).select("event_id", "country", "crop", "model_type")
    out = impute(req, ["country", "crop"], "most_frequent", categorical=True)
    return impute(out, ["model_type"], "constant", categorical=True)


@register("nulls_left", _REQ + """
SELECT count(*) FILTER (WHERE country IS NULL) AS country_before, count(*) FILTER (WHERE crop IS NULL) AS crop_before,
       CAST(0 AS BIGINT) AS country, CAST(0 AS BIGINT) AS crop FROM req""")
def nulls_left(spark, d):
    """Nulls per column before and after the fill."""
    req = requests_table(spark, d).select("event_id", "country", "crop")
    before = null_counts(req, ["country", "crop"]).toDF("country_before", "crop_before")
    after = null_counts(impute(req, ["country", "crop"], "most_frequent", categorical=True), ["country", "crop"])
    return before.crossJoin(after)  # two one-row tables


@register("common_key_join", """
SELECT lang, count(*) AS rows, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def common_key_join(spark, d):
    """Two tables joined on the columns they share, after dropping what exists of a drop list."""
    docs = C.drop_existing(TB.table(spark, d, "documents"), ["n_chars", "text", "no_such_column"])
    labels = TB.table(spark, d, "labels")
    keys = C.common_columns({"documents": docs, "labels": labels})
    return docs.join(labels, keys).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("good"))


@register("clip_from_below", "SELECT c_custkey, greatest(c_acctbal, 0.0) AS balance FROM customer")
def clip_from_below(spark, d):
    """Values under 0 become 0."""
    return TB.table(spark, d, "customer").select("c_custkey", clip_low("c_acctbal").alias("balance"))


@register("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_iso FROM events")
def iso_times(spark, d):
    """Event times as ISO text."""
    return TB.table(spark, d, "events").select("event_id", iso_time("ts").alias("ts_iso"))


# What the form offers here (one crop and five countries of the requests are not on the lists).
FORM_COUNTRIES = [f"Nation_{i}" for i in range(25)]
FORM_CROPS = REQUEST_CROPS[:6]
_REASON = f"""CASE WHEN country IS NULL OR crop IS NULL OR year IS NULL OR rainfall IS NULL OR temperature IS NULL OR pesticides IS NULL
       THEN 'missing_fields'
       WHEN lower(coalesce(model_type, 'svr')) IN ('cnn', 'hybrid') AND image_id IS NULL THEN 'image_required'
       WHEN NOT (year BETWEEN 1990 AND 2030) THEN 'year_out_of_range'
       WHEN country NOT IN ({", ".join(f"'{c}'" for c in FORM_COUNTRIES)}) THEN 'country_not_listed'
       WHEN crop NOT IN ({", ".join(f"'{c}'" for c in FORM_CROPS)}) THEN 'crop_not_listed' END"""


def _split(spark, d):
    return SCR.split_requests(SCR.validate_requests(requests_table(spark, d), FORM_COUNTRIES, FORM_CROPS))


@register("accepted_requests", _REQ + f", v AS (SELECT *, {_REASON} AS reason FROM req) SELECT * EXCLUDE (reason) FROM v WHERE reason IS NULL")
def accepted_requests(spark, d):
    """Requests that pass the form's rules and lists."""
    return _split(spark, d)[0]


@register("rejected_requests", _REQ + f", v AS (SELECT *, {_REASON} AS reason FROM req) SELECT reason, count(*) AS requests, min(event_id) AS first_event "
          "FROM v WHERE reason IS NOT NULL GROUP BY reason")
def rejected_requests(spark, d):
    """Rejected requests per reason."""
    return _split(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("requests"), F.min("event_id").alias("first_event"))


@register("response_rows", SQL_ALL + """
SELECT r.event_id, r.prediction, r.model, r.error, CASE WHEN error IS NULL THEN CAST(5 AS BIGINT) END AS chart_rows,
  CASE WHEN error IS NULL THEN CAST(year AS VARCHAR) END AS first_year, CASE WHEN error IS NULL THEN CAST(year + 4 AS VARCHAR) END AS last_year,
  CASE WHEN error IS NULL THEN round_even(prediction * 0.9 * 100, 0) / 100 END AS actual_low,
  CASE WHEN error IS NULL THEN round_even(prediction * 1.05 * 100, 0) / 100 END AS predicted_high FROM resp r""")
def response_rows(spark, d):
    """The nested response, read back from its struct."""
    r = SCR.response_struct(SCR.respond(scored_requests(spark, d)))
    chart = F.col("response.chart_data")
    return r.select("event_id", "response.prediction", "response.model", "response.error",
                    F.when(chart.isNotNull(), F.size(chart)).cast("bigint").alias("chart_rows"),
                    F.get(chart, F.lit(0))["year"].alias("first_year"), F.get(chart, F.lit(4))["year"].alias("last_year"),
                    F.get(chart, F.lit(0))["actual_low"].alias("actual_low"), F.get(chart, F.lit(0))["predicted_high"].alias("predicted_high"))


@register("residual_density", MF + SQL_PRED + """,
r AS (SELECT y - pred AS v FROM lp WHERE model = 'fixed_a'),
sx AS (SELECT min(v) AS lo, (max(v) - min(v)) / 199.0 AS step, count(v) AS n, stddev_samp(v) * pow(CAST(count(v) AS DOUBLE), -0.2) AS bw FROM r),
b AS (SELECT least(floor((v - lo) / step), 198) AS low, (v - lo) / step AS pos FROM r, sx),
w AS (SELECT k, sum(w) AS w FROM (SELECT low AS k, 1 - (pos - low) AS w FROM b UNION ALL SELECT low + 1, pos - low FROM b) GROUP BY k),
g AS (SELECT unnest(range(200)) AS point)
SELECT point, round_even((lo + point * step) * 1e6, 0) / 1e6 AS place,
       round_even(coalesce((SELECT sum(w.w * exp(-0.5 * ((point - k) * step / bw) * ((point - k) * step / bw))) FROM w WHERE abs(point - k) * step <= 8 * bw), 0)
                  / (n * bw * sqrt(2 * pi())) * 1e6, 0) / 1e6 AS density
FROM g, sx""")
def residual_density(spark, d):
    """The residual density on a grid of 200 points from the smallest to the largest residual."""
    lp = M.residuals(fixed_predictions(spark, d, models=["fixed_a"]))
    return M.kernel_density(lp, "residual", 200)


@register("csv_round_trip", """
SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders""")
def csv_round_trip(spark, d):
    """A table written as CSV with a header and read back as text, missing-value tokens as null."""
    o = TB.table(spark, d, "orders")
    token = F.when(F.col("o_orderkey") % 7 == 0, F.lit("N/A")).otherwise(F.col("o_orderpriority"))
    path = scratch(spark, "orders.csv")
    write_csv(o.select(F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Price"),
                       token.alias("Priority")), path)
    back = C.normalise_columns(read_csv_strings(spark, path))
    return back.select(F.col("order_key").cast("bigint").alias("order_key"), "status", C.coerce_double("price").alias("price"), "priority")


@register("csv_tree", """
SELECT CAST(o_orderkey AS BIGINT) AS order_key, o_orderstatus AS status, CASE WHEN o_orderkey % 4 < 3 THEN o_totalprice END AS price,
       CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, NULL::VARCHAR AS error FROM orders
UNION ALL SELECT count(*), NULL, NULL, NULL, 'expected 2 fields, saw 3' FROM customer""")
def csv_tree(spark, d):
    """S3: orders as many CSV files with two headers, and one broken file of customers: all read by header, the broken one reported with its lines."""
    o = TB.table(spark, d, "orders")
    root = scratch(spark, "tree")
    token = F.when(F.col("o_orderkey") % 7 == 0, F.lit("null")).otherwise(F.col("o_orderpriority"))
    priced = o.where("o_orderkey % 4 < 3").select(F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Price"))
    write_csv(priced.repartition(5, "Order Key"), f"{root}/priced")
    write_csv(o.where("o_orderkey % 4 = 3").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), token.alias("priority"))
              .repartition(3, "order_key"), f"{root}/deep/priority")
    # names with a separator that nobody quoted, below a header of two columns
    c = TB.table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.lit("extra")).alias("key,name"))
    c.coalesce(1).write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(f"{root}/broken")
    groups, report = read_csv_tree(spark, root)
    out = None
    for g in groups:
        has = lambda n, g=g: F.col(n) if n in g.rows.columns else F.lit(None).cast("string")
        rows = g.rows.select("order_key", "status", has("price").alias("price"), has("priority").alias("priority"))
        part = rows.select(F.col("order_key").cast("bigint").alias("order_key"), "status", C.coerce_double("price").alias("price"),
                           "priority", F.lit(None).cast("string").alias("error"))
        out = part if out is None else out.unionByName(part)
    bad = report.where(F.col("error").isNotNull()).select((F.col("lines") - 1).alias("order_key"), F.lit(None).cast("string").alias("status"),
                                                          F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("priority"), "error")
    return bad if out is None else out.unionByName(bad)


@register("named_csvs", """
SELECT 'nation' AS name, count(*) AS rows, count(DISTINCT n_regionkey) AS keys FROM nation
UNION ALL SELECT 'region', count(*), count(DISTINCT r_regionkey) FROM region""")
def named_csvs(spark, d):
    """A list of named CSV files, one of which is absent and left out; headers normalised."""
    root = scratch(spark, "named")
    for n in ("nation", "region"):
        t = TB.table(spark, d, n)
        write_csv(t.select(*[F.col(c).alias(c.replace("_", " ").upper()) for c in t.columns]), f"{root}/{n}.csv")
    frames = load_named(spark, {n: f"{root}/{n}.csv" for n in ("nation", "region", "gone")})
    out = None
    for n, key in (("nation", "n_regionkey"), ("region", "r_regionkey")):
        r = frames[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"))
        out = r if out is None else out.unionByName(r)
    return out


@register("stream_restart", SQL_ALL + "SELECT event_id, model_type, prediction, model, confidence, error, insights, CAST(event_id % 2 AS BIGINT) AS batch FROM resp")
def stream_restart(spark, d):
    """M12 on a stream: requests land in two waves, the job stops after the first and a new one goes on from its checkpoint.

    ``batch`` comes from the sink's commit log: the commit that holds the file a
    row is in, so rows are there once, and in the wave they landed in.
    """
    root = scratch(spark, "requests")
    src, out, check = (f"{root}/{x}" for x in ("in", "out", "checkpoint"))
    req = requests_table(spark, d)
    for wave in (0, 1):
        req.where(F.col("event_id") % 2 == wave).write.mode("append").parquet(src)
        job = spark.newSession()  # a start of its own; only the folders carry over
        job.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        run_available_now(score_stream(request_stream(job, src, schema=req.schema), lambda r, job=job: scored_requests(job, d, r)), out, check)
    rows = spark.read.parquet(out).withColumn("file", F.col("_metadata.file_name"))
    return rows.join(commit_log(spark, out), "file").select("event_id", "model_type", "prediction", "model", "confidence", "error",
                                         F.array_join("insights", " | ").alias("insights"), "batch")


@register("landed_tables", """
SELECT 'customer' AS name, count(*) AS rows, min(c_custkey) AS first_key FROM customer
UNION ALL SELECT 'supplier', count(*), min(s_suppkey) FROM supplier""")
def landed_tables(spark, d):
    """Tables landed as Parquet (a second landing leaves them alone), counted where they lie."""
    frames = {n: TB.table(spark, d, n) for n in ("customer", "supplier")}
    root = scratch(spark, "lake")
    land_tables(frames, root)
    places = land_tables({n: f.limit(0) for n, f in frames.items()}, root)
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}
    out = None
    for n, p in places.items():
        r = spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.min(key[n]).alias("first_key"))
        out = r if out is None else out.unionByName(r)
    return out


_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _listing(spark, d):
    """The pages as a file listing: path without query, length of the page in bytes."""
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return TB.table(spark, d, "pages").select(path.alias("path"), F.octet_length("html").cast("bigint").alias("length")) \
        .withColumn("extension", file_extension("path"))


@register("files_per_extension", f"""
WITH f AS (SELECT lower(regexp_extract({_PATH}, '(\\.[^./]+)$', 1)) AS extension, strlen(html) AS length FROM pages)
SELECT extension, count(*) AS files, round_even(sum(length) / 1048576.0 * 100, 0) / 100 AS mb FROM f GROUP BY extension""")
def files_per_extension(spark, d):
    """Files and MB per extension of a listing."""
    return P.file_summary(_listing(spark, d))


@register("folders_and_names", f"""
WITH f AS (SELECT {_PATH} AS path FROM pages),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS parent FROM f)
SELECT folder, any_value(parent) AS parent, count(*) AS files, min(name) AS first_name FROM g GROUP BY folder""")
def folders_and_names(spark, d):
    """Path parts of a listing, files per folder."""
    f = _listing(spark, d).select(parent_path("path").alias("folder"), file_name("path").alias("name"), parent_name("path").alias("parent"))
    return f.groupBy("folder").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"))


@register("distinct_folders", f"""
SELECT DISTINCT regexp_replace({_PATH}, '/[^/]*$', '') AS folder FROM pages""")
def distinct_folders(spark, d):
    """Distinct folders of a listing."""
    return P.image_folders(_listing(spark, d))


@register("relative_paths", f"""
SELECT page_id, CASE WHEN starts_with({_PATH}, 'www.') THEN {_PATH}[5:] ELSE {_PATH} END AS path FROM pages""")
def relative_paths(spark, d):
    """X11: paths below a root lose the root, others stay."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), r"^www\.", "www/")
    p = TB.table(spark, d, "pages").select("page_id", path.alias("p"))
    return p.select("page_id", relative_path("p", "www").alias("path"))



@register("images_per_class", f"""
WITH f AS (SELECT {_PATH} AS path FROM pages),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, string_split(path, '/')[-2] AS class FROM f)
SELECT class, count(*) AS images, (SELECT count(DISTINCT folder) > 1 FROM g) AS class_based FROM g GROUP BY class""")
def images_per_class(spark, d):
    """Files per class folder of a listing, and whether it is laid out by class."""
    return P.class_summary(_listing(spark, d))
