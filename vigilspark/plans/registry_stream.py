"""Registered streaming queries (each runs its stream to completion and
returns the sink's contents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import queries as SQ
from .registry import QUERIES, query

QUERIES["stream_inbound"] = SQ.stream_inbound
QUERIES["stream_redact"] = SQ.stream_redact
QUERIES["stream_rate_limit"] = SQ.stream_rate_limit
QUERIES["stream_replay"] = SQ.stream_replay
QUERIES["stream_client_minutes"] = SQ.stream_client_minutes
QUERIES["stream_daily_stats"] = SQ.stream_daily_stats
QUERIES["stream_hourly"] = SQ.stream_hourly
QUERIES["stream_live"] = SQ.stream_live


@query("stream_audit")
def stream_audit(spark, sf_dir):
    e = SQ.stream_audit(spark, sf_dir)
    return e.select("id", "timestamp", "event_type", "severity", "user_id", "session_id", "prompt",
                    "response", "action_taken", "blocked",
                    F.col("detected_patterns").isNotNull().alias("has_patterns"))
