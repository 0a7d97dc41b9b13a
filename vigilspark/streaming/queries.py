"""Streaming forms of the operators.

Every function builds a streaming plan over a driver table read as a file
stream, runs it to completion with ``availableNow`` (a real deployment uses a
processing-time trigger on the same plan), and returns the sink's contents as a
batch DataFrame, so the result can be compared with the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators import inbound as IB
from ..operators import outbound as OB
from ..operators import proxy as PX
from ..operators.validate import validate_requests
from ..sources import fixtures as FX
from . import io
from .limiter import stream_rate_limit as _stateful_limit

WATERMARK = "5 minutes"
REPLAY_MS = 3_600_000  # how long the audit stream remembers request ids


def _ltz(c: str):
    return F.col(c).cast("timestamp")


def _wall_as_utc(spark: SparkSession, c: str):
    """Event time for ``window()``: the wall-clock (TIMESTAMP_NTZ) value read
    as UTC, so minute/hour/day windows align with the batch buckets in any
    session time zone (``window`` aligns to UTC epoch instants)."""
    return F.from_utc_timestamp(_ltz(c), spark.conf.get("spark.sql.session.timeZone"))


def _window_start_ntz(spark: SparkSession, start):
    """Inverse of ``_wall_as_utc`` for a window start, as TIMESTAMP_NTZ."""
    return F.to_utc_timestamp(start, spark.conf.get("spark.sql.session.timeZone")).cast("timestamp_ntz")


def stream_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless inbound scan of the prompt stream."""
    p = FX.prompts_from(io.stream_table(spark, sf_dir, "conversations"))
    s = IB.inbound_scan(p, "prompt").select(
        "request_id", "passed", "threat_type", "severity", "confidence", "message",
        F.array_join("matched_patterns", " ;; ").alias("matched"),
        F.array_join("all_threats", ",").alias("all_threats"),
        F.col("rule_detections").cast("long").alias("rule_detections"))
    return spark.read.parquet(io.run_append(s))


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound scan and redaction of the response stream."""
    r = FX.responses_from(io.stream_table(spark, sf_dir, "documents"))
    s = OB.outbound_scan(r, "text").select(
        F.col("id").alias("doc_id"), "threat_type", "severity", "confidence", "pii_count", "secrets_count",
        F.size("findings").cast("long").alias("n_findings"), "excessive_length", "passed", "final_text")
    return spark.read.parquet(io.run_append(s))


def _event_stream(spark, sf_dir):
    e = FX.security_events_from(io.stream_table(spark, sf_dir, "events"))
    return e.withColumn("ts", _ltz("timestamp"))


def stream_rate_limit(spark: SparkSession, sf_dir: str, limit: int = 2, unit: str = "day") -> DataFrame:
    """S3: stateful per-user fixed-window limiter (same parameters as the
    batch ``rate_limit`` query)."""
    e = _event_stream(spark, sf_dir).select("id", "user_id", "ts")
    r = _stateful_limit(e, "user_id", "ts", "id", limit=limit, unit=unit, delay=WATERMARK)
    out = r.select("id", "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                   "allowed", "late")
    return spark.read.parquet(io.run_append(out)).drop("late")


def without_replays(df: DataFrame, id_col: str, ts_col: str, within: str) -> DataFrame:
    """The first of the rows with equal ids whose times lie ``within`` of each other.  Ids leave
    the state when the watermark passes; Spark drops rows behind the watermark, so a stream
    that must keep late rows uses the limiter's own memory of ids instead (``dedup_ms``)."""
    return df.withWatermark(ts_col, within).dropDuplicatesWithinWatermark([id_col])


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream delivered twice, each event kept once."""
    cols = ["id", "user_id", "event_type", "blocked", "ts"]
    e = _event_stream(spark, sf_dir).select(*cols)
    twice = e.union(_event_stream(spark, sf_dir).select(*cols))
    out = without_replays(twice, "id", "ts", "1 hour")
    return spark.read.parquet(io.run_append(out)).select("id", "user_id", "event_type", "blocked", F.col("ts").cast("timestamp_ntz").alias("timestamp"))


def client_minutes(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """S4 plan over an event stream: requests per (minute, user).  Rows without a time are left
    out, rows more than ``delay`` behind the newest may be."""
    spark = events.sparkSession
    e = events.withColumn("ts", _wall_as_utc(spark, "timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests")) \
        .select(_window_start_ntz(spark, F.col("w.start")).alias("window_start"), "user_id", "requests")


def daily_stats(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """S5 plan over an event stream: the statistics of each day, late rows as in ``client_minutes``."""
    spark = events.sparkSession
    e = events.withColumn("ts", _wall_as_utc(spark, "timestamp")).withWatermark("ts", delay)
    agg = e.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("blocked")).alias("blocked_requests"),
        F.count_if(F.col("event_type") == "prompt_injection").alias("prompt_injections"),
        F.count_if(F.col("event_type") == "data_leak").alias("data_leaks"),
        F.avg("processing_time_ms").alias("avg_t"))
    return agg.select(F.to_date(_window_start_ntz(spark, F.col("w.start"))).alias("date"), "total_requests",
                      "blocked_requests",
                      "prompt_injections", "data_leaks",
                      F.round(F.coalesce("avg_t", F.lit(0.0)), 6).alias("avg_processing_time_ms"))


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """S6 plan over an event stream: blocked, allowed and latency by hour, late rows as in ``client_minutes``."""
    spark = events.sparkSession
    r = EV.requests_from_events(events).withColumn("ts", _wall_as_utc(spark, "timestamp")).withWatermark("ts", delay)
    agg = r.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count_if(F.col("blocked")).alias("blocked"), F.count_if(~F.col("blocked")).alias("allowed"),
        F.avg("latency_ms").alias("avg_l"), F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"))
    return agg.select(_window_start_ntz(spark, F.col("w.start")).alias("hour"), "blocked", "allowed",
                      F.round("avg_l", 6).alias("avg_latency"), "min_latency", "max_latency")


def stream_client_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-minute request counts per user (update mode, upserted)."""
    return io.read_upserted(spark, io.run_upsert(client_minutes(_event_stream(spark, sf_dir))), ["window_start", "user_id"])


def stream_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental daily statistics; each micro-batch rewrites the days it
    touched (update mode), the table is the latest row per day."""
    return io.read_upserted(spark, io.run_upsert(daily_stats(_event_stream(spark, sf_dir))), ["date"])


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly blocked/allowed counts and latency over the request stream."""
    return io.read_upserted(spark, io.run_upsert(hourly(_event_stream(spark, sf_dir))), ["hour"])


def stream_live(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """Live monitor, the newest n requests, refreshed per micro-batch."""
    r = EV.requests_from_events(FX.security_events_from(io.stream_table(spark, sf_dir, "events")))
    r = r.select("id", "timestamp", "user_id", "status", "threat_type", "latency_ms", "blocked", "llm_provider")
    out = io.run_top_n(r, [F.col("timestamp").desc(), F.col("id").desc()], n)
    live = io.read_latest_version(spark, out)
    return live.withColumn("row_status", F.when(F.col("blocked"), "blocked")
                           .when(F.col("status") == "success", "success"))


def audit_events_stream(requests: DataFrame, responses: DataFrame | None = None, replay_ms: int = REPLAY_MS) -> DataFrame:
    """S8 (+S9) plan over a request stream: validate -> stateful limiter, which
    drops request ids replayed within ``replay_ms`` -> inbound -> outbound -> audit rows.  No request
    is dropped for being late: one that arrives after its rate window closed
    cannot be counted, and is logged as limited (fail closed)."""
    p = requests.withColumn("ts", _ltz("ts")).withWatermark("ts", WATERMARK)
    v = validate_requests(p).where(F.col("valid"))
    keep = ["use_ml", "prompt", "model", "max_tokens", "temperature"]
    lim = _stateful_limit(v, "client_id", "ts", "request_id", unit="minute", delay=None, passthrough=keep, dedup_ms=replay_ms)
    events = PX.to_events(PX.scan_outcomes(PX.with_responses(lim.withColumn("allowed", F.coalesce("allowed", F.lit(False))), responses)))
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 (+S9): the audit stream appended to a day-partitioned log."""
    events = audit_events_stream(FX.prompts_from(io.stream_table(spark, sf_dir, "conversations")), FX.answers(spark, sf_dir))
    out = io.run_append(EV.with_event_date(events), partition_by=[EV.EVENT_DATE])
    return spark.read.parquet(out).drop(EV.EVENT_DATE)
