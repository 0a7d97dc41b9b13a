"""Registered queries over the security-event log and the dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as DB
from ..operators import events as EV
from ..operators import limits as LM
from ..operators import stats as ST
from ..sources import fixtures as FX
from .registry import query

AS_OF = FX.AS_OF


def _events(spark, sf_dir):
    return FX.security_events(spark, sf_dir)


def _requests(spark, sf_dir):
    return EV.requests_from_events(_events(spark, sf_dir))


def _incidents(spark, sf_dir):
    return EV.incidents_from_events(_events(spark, sf_dir))


def r6(c):
    return F.round(c, 6)


@query("events_scan")
def events_scan(spark, sf_dir):
    """A1: JSON columns decoded (malformed -> empty, null stays null)."""
    e = EV.decode_events(_events(spark, sf_dir))
    dp = F.col("detected_patterns")
    return e.select("id", F.when(dp.isNotNull(), F.size(dp)).cast("long").alias("n_patterns"),
                    F.array_join("detected_patterns", ",").alias("patterns"),
                    F.variant_get("metadata", "$.k", "string").alias("metadata_k"))


@query("requests_view")
def requests_view(spark, sf_dir):
    return _requests(spark, sf_dir)


@query("incidents_view")
def incidents_view(spark, sf_dir):
    return _incidents(spark, sf_dir)


@query("overview_kpis")
def overview_kpis(spark, sf_dir):
    k = DB.overview_kpis(_requests(spark, sf_dir), AS_OF, hours=24 * 7)
    return k.select("total_requests", "blocked_requests", r6(F.col("avg_latency")).alias("avg_latency"),
                    "unique_threats", r6(F.col("block_rate")).alias("block_rate"))


@query("requests_hourly")
def requests_hourly(spark, sf_dir):
    return DB.requests_hourly(_requests(spark, sf_dir), AS_OF, hours=24)


@query("threat_distribution")
def threat_distribution(spark, sf_dir):
    d = DB.threat_distribution(_requests(spark, sf_dir), AS_OF, hours=24 * 7)
    return d.select("threat_type", "count", r6(F.col("pct")).alias("pct"))


@query("latency_hourly")
def latency_hourly(spark, sf_dir):
    d = DB.latency_hourly(_requests(spark, sf_dir), AS_OF, hours=24)
    return d.select("hour", r6(F.col("avg_latency")).alias("avg_latency"), "min_latency", "max_latency")


@query("top_users")
def top_users(spark, sf_dir):
    return DB.top_users(_requests(spark, sf_dir), AS_OF, hours=24 * 7)


def _incident_list(spark, sf_dir):
    return DB.incident_list(_incidents(spark, sf_dir), _requests(spark, sf_dir), AS_OF, "Last 7 Days")


@query("incident_list")
def incident_list(spark, sf_dir):
    return _incident_list(spark, sf_dir)


@query("incident_stats")
def incident_stats(spark, sf_dir):
    return DB.incident_stats(_incident_list(spark, sf_dir))


@query("incident_search")
def incident_search(spark, sf_dir):
    return DB.search(_incident_list(spark, sf_dir), "Ignore")


@query("incident_page")
def incident_page(spark, sf_dir):
    lst = _incident_list(spark, sf_dir)
    return DB.highlight(DB.page(lst, page_size=25, page_num=2))


@query("event_page")
def event_page(spark, sf_dir):
    """H6: a late page of the whole log, by global row numbers."""
    return DB.page_at(_events(spark, sf_dir), page_size=50, page_num=9).select(*_EVENT_COLS)


@query("incident_pages")
def incident_pages(spark, sf_dir):
    return DB.page_count(_incident_list(spark, sf_dir), page_size=25)


@query("incident_detail")
def incident_detail(spark, sf_dir):
    d = DB.incident_detail(_incidents(spark, sf_dir), _requests(spark, sf_dir))
    return d.select("id", "timestamp", "request_id", "threat_type", "severity", "action_taken",
                    "prompt_length", "response_length", "latency_ms",
                    F.variant_get("details_json", "$.k", "string").alias("details_k"))


@query("live_monitor")
def live_monitor(spark, sf_dir):
    return DB.live_monitor(_requests(spark, sf_dir))


@query("live_stats")
def live_stats(spark, sf_dir):
    s = DB.live_stats(DB.live_monitor(_requests(spark, sf_dir)))
    return s.select("total", "blocked", r6(F.col("avg_latency")).alias("avg_latency"), "users")


@query("overall_stats")
def overall_stats(spark, sf_dir):
    s = ST.overall_stats(_events(spark, sf_dir), AS_OF, days=7)
    return s.select("total_events", "total_blocked", "total_injections", "total_leaks",
                    r6(F.col("avg_processing_time")).alias("avg_processing_time"),
                    "max_processing_time", "min_processing_time")


@query("events_by_type")
def events_by_type(spark, sf_dir):
    return ST.events_by_type(_events(spark, sf_dir), AS_OF, days=7)


def _daily(spark, sf_dir):
    return ST.daily_statistics(_events(spark, sf_dir))


@query("daily_statistics")
def daily_statistics(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return d.select("date", "total_requests", "blocked_requests", "prompt_injections", "data_leaks",
                    r6(F.col("avg_processing_time_ms")).alias("avg_processing_time_ms"))


@query("daily_breakdown")
def daily_breakdown(spark, sf_dir):
    d = ST.daily_breakdown(_daily(spark, sf_dir), AS_OF, days=7)
    return d.select("date", "total_requests", "blocked_requests", "prompt_injections", "data_leaks",
                    r6(F.col("avg_processing_time_ms")).alias("avg_processing_time_ms"))


@query("threat_summary")
def threat_summary(spark, sf_dir):
    return ST.threat_summary(_events(spark, sf_dir), AS_OF, hours=24)


@query("today_summary")
def today_summary(spark, sf_dir):
    return ST.today_summary(_events(spark, sf_dir), "2024-01-30")


@query("user_activity")
def user_activity(spark, sf_dir):
    u = ST.user_activity(_events(spark, sf_dir), AS_OF, days=7)
    return u.select("user_id", "total_requests", "blocked_requests", "injection_attempts",
                    r6(F.col("avg_processing_time")).alias("avg_processing_time"))


@query("statistics_bundle")
def statistics_bundle(spark, sf_dir):
    """The nested bundle, flattened for comparison (type counts and the
    daily rows as ordered text)."""
    b = ST.statistics_bundle(_events(spark, sf_dir), _daily(spark, sf_dir), AS_OF, days=7)
    by_type = F.array_join(F.array_sort(F.transform(F.map_entries("by_event_type"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))), ",")
    days = F.array_join(F.transform("daily_breakdown", lambda d: F.concat(
        d["date"].cast("string"), F.lit(":"), d["total_requests"].cast("string"), F.lit(":"),
        d["blocked_requests"].cast("string"))), ",")
    return b.select(F.col("period_days").cast("long").alias("period_days"),
                    F.col("overall.total_events").alias("total_events"),
                    F.col("overall.total_blocked").alias("total_blocked"),
                    r6(F.col("overall.avg_processing_time")).alias("avg_processing_time"),
                    by_type.alias("by_event_type"), days.alias("daily_breakdown"))


def _response_log(spark, sf_dir):
    e = _events(spark, sf_dir)
    code = (F.when(F.col("event_type") == "prompt_injection", 403).when(F.col("event_type") == "rate_limit", 429)
            .when(F.col("event_type") == "system_error", 500).otherwise(200))
    return e.select(F.col("id"), code.alias("status_code"))


@query("outcome_tally")
def outcome_tally(spark, sf_dir):
    return ST.outcome_tally(_response_log(spark, sf_dir))


_EVENT_COLS = ["id", "timestamp", "event_type", "severity", "user_id", "session_id", "action_taken",
               "processing_time_ms", "blocked"]


@query("recent_events")
def recent_events(spark, sf_dir):
    return ST.recent_events(_events(spark, sf_dir), 50, "prompt_injection", blocked_only=True).select(*_EVENT_COLS)


@query("events_by_user")
def events_by_user(spark, sf_dir):
    return ST.events_by_user(_events(spark, sf_dir), "user_7", 50).select(*_EVENT_COLS)


@query("events_by_user_topk")
def events_by_user_topk(spark, sf_dir):
    n = ST.newest_per_user(_events(spark, sf_dir), 5)
    return n.select("user_id", "id", "timestamp", "event_type", F.col("rank").cast("long").alias("rank"))


@query("rate_limit")
def rate_limit(spark, sf_dir):
    """H8 through the salted operator: per user and day, limit 2 (per-minute
    counts never exceed 2 in the driver's data)."""
    e = _events(spark, sf_dir).select("id", "user_id", "timestamp")
    r = LM.rate_limit(e, "user_id", "timestamp", "id", limit=2, unit="day")
    return r.select("id", "user_id", "window_start", "allowed")


@query("retention_rewrite")
def retention_rewrite(spark, sf_dir):
    """H9: the day-partitioned log rewritten in place; every 97th row has no timestamp."""
    from ..session import scratch_path
    e = _events(spark, sf_dir).withColumn("timestamp", F.when(F.col("id") % 97 != 0, F.col("timestamp")))
    path = scratch_path(spark, "retention")
    EV.append_events(e, path)
    EV.rewrite_retention(spark, path, AS_OF, days_to_keep=14)
    return EV.read_events(spark, path).select(*_EVENT_COLS)


@query("retention")
def retention(spark, sf_dir):
    return EV.retention_report(_events(spark, sf_dir), AS_OF, days_to_keep=14)
