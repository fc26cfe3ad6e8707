"""Request scoring as a Structured Streaming job (M12 on a stream).

The scorer is a stateless projection plus stream-static joins (dictionary,
one-row scaler and intercept tables, image scores), so the batch function
applies unchanged to ``readStream`` input; no state store is involved. Files
landing in a folder are scored as they arrive; ``availableNow`` processes
what is there and stops (used by the tests to compare with the batch result).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.operators.score import respond
from agrolith.session import stage_table

REQUEST_SCHEMA = ("event_id bigint, country string, crop string, year int, rainfall double, "
                  "temperature double, pesticides double, model_type string, image_id bigint")


def request_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                   schema: str = REQUEST_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder)


def score_stream(req_stream: DataFrame, score_fn) -> DataFrame:
    """``score_fn(requests) -> scored table``; the response columns are added per micro-batch row."""
    return respond(score_fn(req_stream)).select(
        "event_id", "model_type", "prediction", "model", "confidence", "error", "insights")


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Write the stream to Parquet, processing all input present now, then stop.

    ``checkpoint`` is a lasting folder of this job, the same one at every start:
    it says which files are done, so a later run goes on where this one ended.
    """
    q = (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def commit_log(spark: SparkSession, out_path: str) -> DataFrame:
    """(file, batch): the files the sink has committed and the first commit that names each.

    DataFrame readers leave out folders that begin with an underscore, so the
    log's few small files are read as texts in tasks.
    """
    import json
    logs = spark.sparkContext.wholeTextFiles(f"{out_path.rstrip('/')}/_spark_metadata/[0-9]*")

    def entries(log):
        batch = int(log[0].rsplit("/", 1)[1].split(".")[0])
        adds = [json.loads(line) for line in log[1].splitlines() if line.startswith("{")]
        return [(a["path"].rsplit("/", 1)[1], batch) for a in adds if a["action"] == "add"]

    rows = spark.createDataFrame(logs.flatMap(entries), "file string, batch bigint")
    # staged: its bytes are known where rows are joined to their file
    return stage_table(rows.groupBy("file").agg(F.min("batch").alias("batch")), "commits")
