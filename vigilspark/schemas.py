"""Schemas of the data model and the value domains.

Nested values that arrive as JSON text stay STRING in storage and are
decoded with ``from_json`` / ``try_parse_json`` by the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.spans import SPAN_TYPE, SPANS_TYPE  # noqa: F401  (re-exported)

# Domains (plain strings, checked with ``domain_violations``).
THREAT_TYPES = ["prompt_injection", "jailbreak", "data_exfiltration", "pii_leak", "api_key_leak",
                "excessive_output", "clean"]
SEVERITIES = ["critical", "high", "medium", "low"]
EVENT_TYPES = ["prompt_injection", "data_leak", "rate_limit", "normal_request", "system_error"]
REQUEST_STATUSES = ["blocked", "success"]
POLICY_TYPES = ["input", "output"]

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SECURITY_EVENTS = _struct(
    ("id", L), ("timestamp", TS), ("event_type", S), ("severity", S), ("user_id", S), ("session_id", S),
    ("prompt", S), ("response", S), ("detected_patterns", S), ("action_taken", S),
    ("processing_time_ms", D), ("metadata", S), ("blocked", B))

DAILY_STATISTICS = _struct(
    ("date", T.DateType()), ("total_requests", L), ("blocked_requests", L), ("prompt_injections", L),
    ("data_leaks", L), ("avg_processing_time_ms", D), ("last_updated", TS))

REQUESTS = _struct(
    ("id", L), ("timestamp", TS), ("user_id", S), ("prompt_length", I), ("response_length", I),
    ("latency_ms", D), ("status", S), ("threat_type", S), ("blocked", B), ("llm_provider", S))

INCIDENTS = _struct(
    ("id", L), ("timestamp", TS), ("request_id", L), ("threat_type", S), ("severity", S),
    ("prompt_snippet", S), ("response_snippet", S), ("action_taken", S), ("details", S))

POLICIES = _struct(
    ("id", L), ("name", S), ("type", S), ("config", S), ("enabled", B), ("last_updated", TS))

POLICY_CHANGES = _struct(
    ("change_id", L), ("name", S), ("op", S), ("type", S), ("config", S), ("enabled", B), ("ts", TS))

REQUESTS_IN = _struct(
    ("request_id", L), ("ts", TS), ("client_id", S), ("host", S), ("use_ml", B), ("prompt", S),
    ("model", S), ("max_tokens", I), ("temperature", D))

RESPONSES_IN = _struct(("id", L), ("text", S))

SCORED = _struct(("id", L), ("label", I), ("score", D))

ROC_POINTS = _struct(("label", S), ("i", I), ("fpr", D), ("tpr", D))

RESPONSE_LOG = _struct(("id", L), ("status_code", I))

INFERENCE_LOG = _struct(("ts", TS), ("inference_time_ms", D))

SECURITY_CHECK = T.StructType([
    T.StructField("passed", B), T.StructField("threat_type", S), T.StructField("severity", S),
    T.StructField("confidence", D), T.StructField("matched_patterns", T.ArrayType(S)),
    T.StructField("sanitized_text", S)])


def domain_violations(df: DataFrame, checks: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns hold a value outside their domain (NULL allowed)."""
    cond: Column | None = None
    for col, values in checks.items():
        bad = F.col(col).isNotNull() & ~F.col(col).isin(values)
        cond = bad if cond is None else (cond | bad)
    return df.where(cond) if cond is not None else df.limit(0)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to ``schema`` (missing columns become NULL)."""
    cols = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
