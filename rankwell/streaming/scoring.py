"""The request stream: check the language, take a token, check the size, answer, log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.text import event_line
from rankwell.session import scratch_path
from rankwell.streaming.limiter import Bucket, limit_stream

FIELDS = ("language", "size", "latency")


def admitted(requests: DataFrame, bucket: Bucket, served: Sequence[str]) -> DataFrame:
    """Requests with ``allowed``; one in an unserved language costs no token."""
    known = (F.col("language") == "auto") | F.col("language").isin(*served)
    return limit_stream(requests.withColumn("counts", known), bucket, carry=FIELDS)


def with_outcome(requests: DataFrame, answers: DataFrame, max_bytes: int) -> DataFrame:
    """Status, answer and engine of admitted requests, by a stream-static join.

    ``answers`` is (event_id, certainty, primary, fallback).
    """
    joined = requests.join(answers, "event_id", "left")
    status = (
        F.when(~F.col("counts"), "bad_request")
        .when(~F.col("allowed"), "rate_limited")
        .when(F.col("size") > max_bytes, "bad_request")
        .otherwise("ok")
    )
    served = F.coalesce(F.col("certainty") != "unknown", F.lit(False))
    ok = F.col("status") == "ok"
    scored = joined.withColumn("status", status).select(
        "event_id", "user_id", "status", "language", "latency",
        F.when(ok, F.when(served, F.col("primary")).otherwise(F.col("fallback"))).alias("answer"),
        F.when(ok, F.when(served, "symbolic").otherwise("ml_fallback")).alias("engine"),
    )
    event = F.concat(F.lit("predict_"), F.col("status"))
    return scored.withColumn("log", event_line(event, ["language", "latency", "answer"]))


def run_to_folder(stream: DataFrame, name: str) -> str:
    """Run a stream over all available input; a batch that is retried replaces itself."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return path
