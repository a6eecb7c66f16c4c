"""Registered queries: rate limits, request metrics, scoring and derivation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.operators import serve
from rankwell.plans.adapters import answers_wide, events, table, utc, with_views
from rankwell.plans.catalog import query
from rankwell.streaming import metrics
from rankwell.streaming.limiter import Bucket, limit_requests, limit_stream
from rankwell.streaming.scoring import admitted, run_to_folder, with_outcome

#: The log is sparse; time runs 100,000 times faster so the limiter has work.
BUCKET = Bucket(time_scale=100_000.0)

_BUCKETS = """takers AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (
    PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE {where}),
  steps AS (SELECT user_id, r, s, event_id, true AS allowed, 19.0::DOUBLE AS tokens
      FROM takers WHERE r = 1
    UNION ALL
    SELECT t.user_id, t.r, t.s, t.event_id, y >= 1.0, CASE WHEN y >= 1.0 THEN y - 1.0 ELSE y END
    FROM (SELECT n.*, least(20.0, p.tokens + greatest(0.0, n.s - p.s) / 100000.0 * 0.5) AS y
      FROM steps p JOIN takers n ON n.user_id = p.user_id AND n.r = p.r + 1) t)"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream.

    The pattern matches the one table name, be it a file or a folder.
    """
    schema = table(spark, sf_dir, "events").schema
    # a micro-batch, and so one client's share of it, stays bounded on any table
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(512 << 20))
    stream = reader.parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", utc())


@query("token_bucket_batch", "T1", sql=f"""
  WITH RECURSIVE {_BUCKETS.format(where='true')} SELECT event_id, allowed FROM steps""")
def _batch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.lit(True).alias("counts")
    )
    return limit_requests(requests, BUCKET).select("event_id", "allowed")


@query("token_bucket_stream", "T1", sql=f"""
  WITH RECURSIVE {_BUCKETS.format(where='true')} SELECT event_id, allowed FROM steps""")
def _stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_stream(spark, sf_dir).withColumn("counts", F.lit(True))
    path = run_to_folder(limit_stream(requests, BUCKET), "limits")
    return spark.read.parquet(path).select("event_id", "allowed")


_HISTOGRAM = "SELECT position, le, n FROM (VALUES {}) t(position, le, bound), LATERAL (SELECT " \
    "count_if(value / 100 <= bound)::BIGINT AS n FROM events)".format(
        ", ".join(
            f"({i}, '{metrics.bound_label(b)}', {'1e300' if b == float('inf') else b}::DOUBLE)"
            for i, b in enumerate(metrics.LATENCY_BOUNDS)
        )
    )


@query("latency_histogram", "T2", sql=_HISTOGRAM)
def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.latency_totals(table(spark, sf_dir, "events"), F.col("value") / 100)
    return metrics.histogram_rows(totals)


@query("request_metrics_text", "T2", sql=f"""
  SELECT 0 AS position, event_type AS key,
    'service_requests_total{{status="' || event_type || '"}} ' || count(*) AS line
  FROM events GROUP BY event_type
  UNION ALL SELECT position + 1, le, 'service_latency_seconds_bucket{{le="' || le || '"}} ' || n
    FROM ({_HISTOGRAM})
  UNION ALL SELECT 9, 'count', 'service_latency_seconds_count ' || count(*) FROM events""")
def _metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    totals = metrics.latency_totals(requests, F.col("value") / 100)
    return metrics.exposition_lines(metrics.status_counts(requests), totals)


@query("status_count_stream", "T2", sql="""
  SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1""")
def _status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankwell.session import scratch_path

    counts = metrics.status_counts(
        event_stream(spark, sf_dir).withColumnRenamed("event_type", "status")
    )
    path = scratch_path(spark, "status")

    def store(batch: DataFrame, batch_id: int) -> None:
        # the complete table every time: a later batch replaces the one before
        batch.write.mode("overwrite").parquet(path)

    run = (
        counts.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, "status-progress"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(path)


_LANGUAGE = {"view": "python", "click": "cpp", "purchase": "java", "signup": "go", "error": "rust"}


@query("request_scoring_stream", "T3", "P7", "P15", "X9", sql=with_views(
    f"""{_BUCKETS.format(where="event_type <> 'error'")},
    s AS (SELECT e.event_id, e.user_id, CASE WHEN event_type = 'error' THEN 'bad_request'
        WHEN NOT allowed THEN 'rate_limited' WHEN floor(value * 200) > 65536 THEN 'bad_request'
        ELSE 'ok' END AS status, CASE event_type {' '.join(
          f"WHEN '{k}' THEN '{v}'" for k, v in _LANGUAGE.items())} END AS language,
        a.certainty, a.rule_time, a.model_time
      FROM events e LEFT JOIN steps USING (event_id)
      LEFT JOIN answers_wide a ON a.case_id = e.event_id)
    SELECT event_id, user_id, status, language, CASE WHEN status = 'ok' THEN
        CASE WHEN coalesce(certainty <> 'unknown', false) THEN rule_time ELSE model_time END END
        AS answer, CASE WHEN status = 'ok' THEN CASE WHEN coalesce(certainty <> 'unknown', false)
        THEN 'symbolic' ELSE 'ml_fallback' END END AS engine,
      'predict_' || status AS logged FROM s""", "answers_wide"))
def _scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.element_at(
        F.create_map(*[F.lit(x) for pair in _LANGUAGE.items() for x in pair]), F.col("event_type")
    )
    requests = event_stream(spark, sf_dir).select(
        "event_id", "user_id", "ts", language.alias("language"),
        F.floor(F.col("value") * 200).alias("size"), (F.col("value") / 100).alias("latency"),
    )
    answers = answers_wide(spark, sf_dir).select(
        F.col("case_id").alias("event_id"), "certainty",
        F.col("rule_time").alias("primary"), F.col("model_time").alias("fallback"),
    )
    served = ("python", "cpp", "java", "javascript", "c", "go")
    scored = with_outcome(admitted(requests, BUCKET, served), answers, 65_536)
    stored = spark.read.parquet(run_to_folder(scored, "scored"))
    return stored.select(
        "event_id", "user_id", "status", "language", "answer", "engine",
        F.get_json_object("log", "$.event").alias("logged"),
    )


# --------------------------------------------------------------------- derivation steps
@query("certainty_rollup", "P14", sql="""
  WITH n AS (SELECT user_id, event_type FROM events
    WHERE event_type IN ('error', 'signup'))
  SELECT c_custkey AS user_id, CASE WHEN bool_or(event_type = 'error') THEN 'unknown'
      WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'assumed' ELSE 'certain' END AS certainty,
    count(*) FILTER (event_type = 'signup') AS assumptions
  FROM customer LEFT JOIN n ON c_custkey = user_id GROUP BY 1""")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return serve.certainty_rollup(programs, notes(spark, sf_dir), "user_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a program: its errors and sign-ups."""
    kind = F.when(F.col("event_type") == "error", "unknown").when(
        F.col("event_type") == "signup", "assumed"
    )
    return table(spark, sf_dir, "events").select(
        "user_id", kind.alias("kind"), F.dayofmonth("ts").alias("line"),
        F.col("props").alias("reason"),
    )


@query("assumed_lines", "P14", sql="""
  SELECT user_id, day(ts)::INT AS line, props AS reason FROM events
  WHERE event_type = 'signup'""")
def _assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.assumptions(notes(spark, sf_dir), "user_id")


_KINDS = {"view": "loop", "click": "recursion", "purchase": "call", "signup": "alloc",
          "error": "other"}
_KIND_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(
        F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type")
    )
    return table(spark, sf_dir, "events").select(
        "user_id", kind.alias("kind"), F.dayofmonth("ts").alias("line"),
        (F.col("event_id") % 2).alias("key"), F.col("event_id").alias("seq"),
        F.concat_ws(" ", "event_type", F.col("event_id")).alias("text"),
        F.lit(25).alias("line_count"),
        F.when(F.col("value") < 7, "  ").otherwise("x = 1").alias("line_text"),
    )


@query("latest_step_wins", "W7", sql=f"""
  SELECT user_id, kind, line, key, arg_max(text, seq) AS text, CASE kind WHEN 'loop' THEN 0
    WHEN 'recursion' THEN 1 WHEN 'call' THEN 2 WHEN 'alloc' THEN 3 ELSE 9 END AS kind_rank
  FROM (SELECT user_id, {_KIND_SQL} AS kind, day(ts)::INT AS line, event_id % 2 AS key,
    event_id AS seq, event_type || ' ' || event_id AS text FROM events) GROUP BY 1, 2, 3, 4""")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.latest_steps(steps(spark, sf_dir), "user_id", F.col("seq"))


@query("salient_steps", "W10", sql=f"""
  SELECT user_id, kind, line, seq, salience FROM (SELECT user_id, {_KIND_SQL} AS kind,
    day(ts)::INT AS line, event_id AS seq, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN
    1.0 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.4 END::DOUBLE AS salience FROM events
    WHERE value >= 7)
  WHERE salience IS NOT NULL AND line BETWEEN 1 AND 25
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, seq) <= 8""")
def _salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.salient_steps(steps(spark, sf_dir), "user_id", "seq").select(
        "user_id", "kind", "line", "seq", "salience"
    )


@query("latency_sums", "T2", sql="""
  SELECT round(sum(value / 100), 4) AS latency_sum, count(*) AS latency_count FROM events""")
def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.latency_totals(table(spark, sf_dir, "events"), F.col("value") / 100)
    return totals.select(F.round("latency_sum", 4).alias("latency_sum"), "latency_count")
