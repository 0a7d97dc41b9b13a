"""Log-book statistics and lookups.

All are single-pass aggregations with map-side partial aggregation; hot keys
(one user with a third of the rows) only cost one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def since_days(as_of: str, days: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(days=F.lit(days))


def since_hours(as_of: str, hours: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(hours=F.lit(hours))


def _sum_if(cond: Column) -> Column:
    """SQL ``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: NULL over no rows."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def overall_stats(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Totals for the period (sums stay NULL when there are no rows)."""
    e = events.where(F.col("timestamp") >= since_days(as_of, days))
    return e.agg(
        F.count(F.lit(1)).alias("total_events"),
        _sum_if(F.col("blocked")).alias("total_blocked"),
        _sum_if(F.col("event_type") == "prompt_injection").alias("total_injections"),
        _sum_if(F.col("event_type") == "data_leak").alias("total_leaks"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
        F.max("processing_time_ms").alias("max_processing_time"),
        F.min("processing_time_ms").alias("min_processing_time"),
    )


def events_by_type(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """G9."""
    return (events.where(F.col("timestamp") >= since_days(as_of, days))
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("count")))


def daily_statistics(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """G14 (full rebuild of the incrementally-maintained table): per UTC day,
    totals and the average of non-null processing times (0 when none)."""
    out = events.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("blocked")).alias("blocked_requests"),
        F.count_if(F.col("event_type") == "prompt_injection").alias("prompt_injections"),
        F.count_if(F.col("event_type") == "data_leak").alias("data_leaks"),
        F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
    )
    if as_of is not None:
        out = out.withColumn("last_updated", _ts(as_of))
    return out


def daily_breakdown(daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """days+1 calendar dates back from the as_of date, newest first."""
    start = F.date_sub(F.to_date(F.lit(as_of)), days)
    return daily.where(F.col("date") >= start).orderBy(F.col("date").desc())


def threat_summary(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Counts for the last ``hours``, NULL sums coalesced to 0."""
    e = events.where(F.col("timestamp") >= since_hours(as_of, hours))
    z = lambda c: F.coalesce(_sum_if(c), F.lit(0).cast("long"))
    sev = F.col("severity")
    return e.agg(
        F.lit(hours).alias("time_window_hours"),
        F.count(F.lit(1)).alias("total_events"),
        z(F.col("blocked")).alias("blocked_requests"),
        z(F.col("event_type") == "prompt_injection").alias("prompt_injections"),
        z(F.col("event_type") == "data_leak").alias("data_leaks"),
        z(sev == "critical").alias("critical"),
        z(sev == "high").alias("high"),
        z(sev == "medium").alias("medium"),
        z(sev == "low").alias("low"),
    )


def today_summary(events: DataFrame, day: str) -> DataFrame:
    """G12 (older variant): counts for one calendar day, sums NULL if empty."""
    e = events.where(F.to_date("timestamp") == F.to_date(F.lit(day)))
    return e.agg(
        F.count(F.lit(1)).alias("total_today"),
        _sum_if(F.col("blocked")).alias("blocked_today"),
        _sum_if(F.col("event_type") == "prompt_injection").alias("injections_today"),
        _sum_if(F.col("event_type") == "data_leak").alias("leaks_today"),
        _sum_if(F.col("severity") == "critical").alias("critical_today"),
    )


def user_activity(events: DataFrame, as_of: str, days: int = 7, user_ids: list[str] | None = None) -> DataFrame:
    """Per-user totals for all users (or a list)."""
    e = events.where(F.col("timestamp") >= since_days(as_of, days))
    if user_ids is not None:
        e = e.where(F.col("user_id").isin(user_ids))
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        _sum_if(F.col("blocked")).alias("blocked_requests"),
        _sum_if(F.col("event_type") == "prompt_injection").alias("injection_attempts"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
    )


def statistics_bundle(events: DataFrame, daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row nesting G8, G9 and G10 for the period.  The three parts
    are single aggregated rows; they are stacked with a union and folded by one
    tiny aggregation (no cross join)."""
    overall = overall_stats(events, as_of, days)
    o_type = overall.schema
    by_type = events_by_type(events, as_of, days).agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("by_event_type"))
    breakdown = daily_breakdown(daily, as_of, days).agg(
        F.sort_array(F.collect_list(F.struct("*")), asc=False).alias("daily_breakdown"))
    m_type = by_type.schema["by_event_type"].dataType
    b_type = breakdown.schema["daily_breakdown"].dataType
    none = lambda t: F.lit(None).cast(t)
    parts = [
        overall.select(F.struct("*").alias("overall"), none(m_type).alias("by_event_type"),
                       none(b_type).alias("daily_breakdown")),
        by_type.select(none(o_type).alias("overall"), "by_event_type", none(b_type).alias("daily_breakdown")),
        breakdown.select(none(o_type).alias("overall"), none(m_type).alias("by_event_type"), "daily_breakdown"),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(
        F.lit(days).alias("period_days"),
        F.first("daily_breakdown", ignorenulls=True).alias("daily_breakdown"),
        F.first("overall", ignorenulls=True).alias("overall"),
        F.first("by_event_type", ignorenulls=True).alias("by_event_type"))


def outcome_tally(response_log: DataFrame) -> DataFrame:
    """Total and 403 / 429 / 200 counts."""
    s = F.col("status_code")
    return response_log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(s == 403).alias("blocked_injections"),
        F.count_if(s == 429).alias("rate_limited"),
        F.count_if(s == 200).alias("successful_normal"))


def recent_events(events: DataFrame, limit: int = 50, event_type: str | None = None,
                  blocked_only: bool = False) -> DataFrame:
    """H1: newest first (id breaks ties), optional filters; a top-k, so Spark
    plans TakeOrderedAndProject (per-partition top-k, then merge)."""
    e = events
    if event_type:
        e = e.where(F.col("event_type") == event_type)
    if blocked_only:
        e = e.where(F.col("blocked"))
    return e.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def events_by_user(events: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    """H2 for one user."""
    return recent_events(events.where(F.col("user_id") == user_id), limit)


def newest_per_user(events: DataFrame, k: int = 50) -> DataFrame:
    """H2 for every user at once: ``row_number() <= k`` per user.  Spark inserts
    a partial WindowGroupLimit before the shuffle, so a hot user contributes at
    most k rows per map task."""
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
