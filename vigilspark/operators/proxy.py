"""Request outcome -> audit-log row (B8-B15), the batch form of the proxy.

validate -> rate limit -> inbound scan -> (response) -> outbound scan -> one
``security_events`` row per valid request.  Everything is one projection chain
over the input: rows that are limited or blocked get a NULL response text, so
the outbound regexes cost nothing for them and there is no branching/union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import truncate, word_count
from . import inbound as IB
from . import limits as LM
from . import outbound as OB
from .validate import validate_requests

# FIXED VALUES: log texts.
ACTION_RATE_LIMIT = "Rate limit exceeded"
ACTION_BLOCKED = "Request blocked"
ACTION_ERROR = "Internal error"
BLOCK_ERROR = "Security policy violation"


def event_type_of(threat: Column) -> Column:
    """Every inbound threat maps to prompt_injection."""
    m = F.create_map(*[x for k, v in rules.THREAT_EVENT_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, threat), F.lit("prompt_injection"))


def severity_level_of(sev: Column) -> Column:
    """Unknown severity -> high."""
    return F.when(sev.isin(rules.SEVERITY_LEVELS), sev).otherwise(F.lit("high"))


def _json_list_or_null(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.to_json(arr))


def process_requests(requests: DataFrame, responses: DataFrame | None = None,
                     block_on_injection: bool = True, redact: bool = True,
                     max_tokens: int = rules.MAX_RESPONSE_TOKENS,
                     limit_per_minute: int | None = rules.MAX_REQUESTS_PER_MINUTE,
                     use_ml_default: bool = False, salts: int = 64) -> DataFrame:
    """Valid requests with their rate-limit, inbound and outbound outcomes.

    ``responses`` (request_id, response) holds the answers; they are joined after
    the limiter, so its shuffles carry no response text.  A request without an
    answer stays, with a NULL response."""
    v = validate_requests(requests, use_ml_default=use_ml_default).where(F.col("valid"))
    if limit_per_minute is not None:
        v = LM.rate_limit(v, "client_id", "ts", "request_id", limit=limit_per_minute, unit="minute", salts=salts)
    else:
        v = v.withColumn("allowed", F.lit(True))
    return scan_outcomes(with_responses(v, responses), block_on_injection, redact, max_tokens)


def with_responses(v: DataFrame, responses: DataFrame | None) -> DataFrame:
    if responses is None:
        return v if "response" in v.columns else v.withColumn("response", F.lit(None).cast("string"))
    return v.join(responses.select("request_id", "response"), "request_id", "left")


def scan_outcomes(v: DataFrame, block_on_injection: bool = True,
                  redact: bool = True, max_tokens: int = rules.MAX_RESPONSE_TOKENS) -> DataFrame:
    """Inbound + outbound stages for validated rows carrying ``allowed`` and ``response``
    (stateless, so it runs unchanged on a stream after the stateful limiter)."""
    s = IB.inbound_scan(v, "prompt", use_ml=F.col("use_ml"))
    s = s.withColumnRenamed("passed", "prompt_passed").withColumnRenamed("threat_type", "prompt_threat") \
        .withColumnRenamed("severity", "prompt_severity").withColumnRenamed("confidence", "prompt_confidence") \
        .withColumnRenamed("matched_patterns", "prompt_patterns").withColumnRenamed("message", "prompt_message")
    blocked = ~F.col("prompt_passed") & F.lit(block_on_injection)
    s = s.withColumn("outcome", F.when(~F.col("allowed"), "rate_limited").when(blocked, "blocked")
                     .otherwise("served"))
    s = s.withColumn("response_raw", F.when(F.col("outcome") == "served", F.col("response")))
    o = OB.outbound_scan(s, "response_raw", redact=redact, max_tokens=max_tokens)
    return o


def to_events(processed: DataFrame) -> DataFrame:
    """One audit row per processed request (security_events schema)."""
    outcome = F.col("outcome")
    limited, blocked = outcome == "rate_limited", outcome == "blocked"
    details = F.struct(
        F.col("prompt_message").alias("message"), F.col("all_threats").alias("all_threats"),
        F.col("ml_prediction").alias("ml_prediction"), F.col("ml_confidence").alias("ml_confidence"),
        F.col("rule_detections").alias("rule_detections"), F.col("ml_used").alias("ml_used"))
    blocked_meta = F.to_json(F.struct(
        F.col("prompt_confidence").alias("confidence"), details.alias("details"),
        F.col("ml_used").alias("ml_used"), F.col("prompt_threat").alias("threat_type")))
    served_meta = F.to_json(F.struct(
        F.col("model").alias("model"), (~F.col("passed")).alias("pii_detected"), F.col("ml_used").alias("ml_used")))
    return processed.select(
        F.col("request_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(limited, "rate_limit").when(blocked, event_type_of(F.col("prompt_threat")))
         .otherwise("normal_request").alias("event_type"),
        F.when(limited, "medium").when(blocked, severity_level_of(F.col("prompt_severity")))
         .otherwise("low").alias("severity"),
        F.col("client_id").alias("user_id"),
        F.col("request_id").cast("string").alias("session_id"),
        F.when(limited, truncate(F.col("prompt"), 100)).otherwise(truncate(F.col("prompt"), 1000)).alias("prompt"),
        F.when(outcome == "served", truncate(F.col("final_text"), 1000)).alias("response"),
        F.when(blocked, _json_list_or_null(F.col("prompt_patterns"))).alias("detected_patterns"),
        F.when(limited, ACTION_RATE_LIMIT).when(blocked, ACTION_BLOCKED).alias("action_taken"),
        F.lit(None).cast("double").alias("processing_time_ms"),
        F.when(blocked, blocked_meta).when(outcome == "served", served_meta).alias("metadata"),
        (limited | blocked).alias("blocked"),
    )


def error_events(df: DataFrame, error_col: str = "error", error_type_col: str = "error_type") -> DataFrame:
    """Rows whose processing produced an error -> system_error rows."""
    e = df.where(F.col(error_col).isNotNull())
    return e.select(
        F.col("request_id").alias("id"), F.col("ts").alias("timestamp"),
        F.lit("system_error").alias("event_type"), F.lit("high").alias("severity"),
        F.col("client_id").alias("user_id"), F.col("request_id").cast("string").alias("session_id"),
        truncate(F.col("prompt"), 1000).alias("prompt"), F.lit(None).cast("string").alias("response"),
        F.lit(None).cast("string").alias("detected_patterns"), F.lit(ACTION_ERROR).alias("action_taken"),
        F.lit(None).cast("double").alias("processing_time_ms"),
        F.to_json(F.struct(F.col(error_col).alias("error"), F.col(error_type_col).alias("error_type")))
         .alias("metadata"),
        F.lit(True).alias("blocked"))


def block_reasons(processed: DataFrame) -> DataFrame:
    """The 403 body for blocked requests."""
    return processed.where(F.col("outcome") == "blocked").select(
        F.col("request_id"), F.lit(BLOCK_ERROR).alias("error"), F.col("prompt_threat").alias("threat_type"),
        F.col("prompt_severity").alias("severity"), F.col("prompt_message").alias("message"))


def proxy_results(processed: DataFrame) -> DataFrame:
    """B15 (+B8): the 200 body for served requests, usage = word counts."""
    served = processed.where(F.col("outcome") == "served")
    return served.select(
        F.col("request_id").alias("id"), "model", F.col("final_text").alias("response"),
        F.struct(word_count(F.col("prompt")).alias("prompt_tokens"),
                 word_count(F.col("final_text")).alias("completion_tokens")).alias("usage"),
        F.struct(F.struct(F.col("prompt_passed").alias("passed"), F.col("ml_used").alias("ml_used")).alias("prompt_check"),
                 F.struct(F.col("passed").alias("passed"),
                          F.col("sanitized_text").isNotNull().alias("redacted")).alias("response_check"))
         .alias("security"))
