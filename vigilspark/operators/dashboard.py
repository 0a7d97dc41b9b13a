"""Dashboard queries over ``requests`` and ``incidents``.

Windows are half-open on the past (``timestamp > as_of - range``), matching the
dashboard.  Search and paging happen inside the plan, not in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import row_numbers

from .stats import since_hours

TIME_RANGES_HOURS = {"Last Hour": 1, "Last 24 Hours": 24, "Last 7 Days": 24 * 7, "Last 30 Days": 24 * 30}
INCIDENT_RANGES_HOURS = {"Last 24 Hours": 24, "Last 7 Days": 24 * 7, "Last 30 Days": 24 * 30, "All Time": None}
SEVERITY_CHOICES = ["critical", "high", "medium", "low"]
THREAT_CHOICES = ["prompt_injection", "pii_leak", "data_exfiltration", "jailbreak"]
PAGE_SIZES = [10, 25, 50, 100]


def hour_bucket(ts: str) -> Column:
    """Start of the hour (Q1), kept as TIMESTAMP_NTZ like the input
    (``date_trunc`` returns a session-zone TIMESTAMP)."""
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def _recent(df: DataFrame, as_of: str, hours: int | None, ts: str = "timestamp") -> DataFrame:
    return df if hours is None else df.where(F.col(ts) > since_hours(as_of, hours))


def overview_kpis(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """G1: one aggregation instead of four scans."""
    r = _recent(requests, as_of, hours)
    blocked = F.col("blocked")
    total = F.count(F.lit(1))
    n_blocked = F.count_if(blocked)
    return r.agg(
        total.alias("total_requests"),
        n_blocked.alias("blocked_requests"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"),
        F.count_distinct(F.when(blocked & F.col("threat_type").isNotNull(), F.col("threat_type")))
         .alias("unique_threats"),
        F.when(total > 0, n_blocked / total * 100).otherwise(F.lit(0.0)).alias("block_rate"),
    )


def requests_hourly(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Blocked / allowed per hour; null ``blocked`` counts in neither."""
    r = _recent(requests, as_of, hours)
    return (r.groupBy(hour_bucket("timestamp").alias("hour"))
            .agg(F.count_if(F.col("blocked")).alias("blocked"),
                 F.count_if(~F.col("blocked")).alias("allowed"))
            .orderBy("hour"))


def threat_distribution(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Blocked requests per threat type with their share (%).  The share
    window runs over the aggregated rows (one per threat type), not raw rows."""
    r = _recent(requests, as_of, hours).where(F.col("blocked") & F.col("threat_type").isNotNull())
    counts = r.groupBy("threat_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def latency_hourly(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """G4."""
    r = _recent(requests, as_of, hours)
    return (r.groupBy(hour_bucket("timestamp").alias("hour"))
            .agg(F.avg("latency_ms").alias("avg_latency"), F.min("latency_ms").alias("min_latency"),
                 F.max("latency_ms").alias("max_latency"))
            .orderBy("hour"))


def top_users(requests: DataFrame, as_of: str, hours: int = 24, k: int = 5) -> DataFrame:
    """Busiest users (user id breaks ties)."""
    r = _recent(requests, as_of, hours)
    return (r.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("blocked")).alias("blocked"),
                 F.round(F.avg("latency_ms"), 1).alias("avg_latency"))
            .orderBy(F.col("total").desc(), F.col("user_id")).limit(k))


def incident_list(incidents: DataFrame, requests: DataFrame, as_of: str, time_range: str = "Last 24 Hours",
                  severities=("critical", "high"), threats=tuple(THREAT_CHOICES),
                  max_lag_hours: int | None = 24) -> DataFrame:
    """incidents LEFT JOIN requests, filtered, newest first.  An empty
    multiselect yields no rows (Q19).  Filters sit below the join, on both sides:
    an incident is written while its request is handled, so only requests from
    ``max_lag_hours`` before the range on are read (None: all; an incident whose
    request is older has a null user then)."""
    if not severities or not threats:
        return incidents.limit(0).select(
            "id", "timestamp", "threat_type", "severity", "prompt_snippet", "action_taken",
            F.lit(None).cast("string").alias("user_id"))
    i = _recent(incidents, as_of, INCIDENT_RANGES_HOURS[time_range])
    i = i.where(F.col("severity").isin(list(severities)) & F.col("threat_type").isin(list(threats)))
    # renamed columns + name-based condition: both sides may come from the same
    # log DataFrame (a self-join), where Dataset column references are ambiguous
    hours = INCIDENT_RANGES_HOURS[time_range]
    bound = None if hours is None or max_lag_hours is None else hours + max_lag_hours
    r = _recent(requests, as_of, bound).select(F.col("id").alias("_r_id"), F.col("user_id").alias("_r_user_id"))
    j = i.join(r, F.col("request_id") == F.col("_r_id"), "left")
    return j.select("id", "timestamp", "threat_type", "severity", "prompt_snippet", "action_taken",
                    F.col("_r_user_id").alias("user_id")).orderBy(F.col("timestamp").desc(), F.col("id").desc())


def search(df: DataFrame, term: str | None) -> DataFrame:
    """H5: keep rows where any column value contains ``term``, ignoring case."""
    if not term:
        return df
    t = term.lower()
    cond = None
    for c in df.columns:
        hit = F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
        cond = hit if cond is None else (cond | hit)
    return df.where(cond)


def page(df: DataFrame, page_size: int = 25, page_num: int = 1, order: list[Column] | None = None) -> DataFrame:
    """H6: one page of an ordered list; Spark plans a top-(offset+limit)
    (TakeOrderedAndProject), so no global single-partition window."""
    if page_size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    order = order or [F.col("timestamp").desc(), F.col("id").desc()]
    return df.orderBy(*order).offset((page_num - 1) * page_size).limit(page_size)


def page_at(df: DataFrame, page_size: int = 25, page_num: int = 1, order: list[Column] | None = None) -> DataFrame:
    """H6: any page of a long ordered list, by global row numbers: no task and no driver brings the
    pages before it together (``page`` is the cheaper form for the first ones)."""
    if page_size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    order = order or [F.col("timestamp").desc(), F.col("id").desc()]
    numbered = row_numbers(df, order, "_row")
    last = page_num * page_size
    return numbered.where(F.col("_row").between(last - page_size + 1, last)).orderBy("_row").drop("_row")


def page_count(df: DataFrame, page_size: int = 25) -> DataFrame:
    """H6: pages = (n - 1) div size + 1, at least 1."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"),
                  F.when(n > 0, F.floor((n - 1) / page_size) + 1).otherwise(1).cast("long").alias("total_pages"))


def highlight(df: DataFrame) -> DataFrame:
    """H7: critical/high rows are highlighted."""
    return df.withColumn("highlight", F.col("severity").isin("critical", "high"))


def incident_stats(incidents_view: DataFrame) -> DataFrame:
    """On the filtered list: total, critical+high, distinct non-null users."""
    return incidents_view.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"),
        F.count_distinct("user_id").alias("affected_users"))


def incident_detail(incidents: DataFrame, requests: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """incident columns plus request lengths and latency; details JSON
    parsed (raw text kept when invalid)."""
    i = incidents if ids is None else incidents.where(F.col("id").isin(ids))
    r = requests.select(F.col("id").alias("_r_id"), F.col("prompt_length").alias("_pl"),
                        F.col("response_length").alias("_rl"), F.col("latency_ms").alias("_lat"))
    j = i.join(r, F.col("request_id") == F.col("_r_id"), "left") \
        .withColumnRenamed("_pl", "prompt_length").withColumnRenamed("_rl", "response_length") \
        .withColumnRenamed("_lat", "latency_ms").drop("_r_id")
    return j.withColumn("details_json", F.try_parse_json("details"))


def live_monitor(requests: DataFrame, n: int = 50) -> DataFrame:
    """H3 + H7: newest n requests with a row status colour key."""
    r = requests.select("id", "timestamp", "user_id", "status", "threat_type", "latency_ms", "blocked",
                        "llm_provider")
    r = r.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
    return r.withColumn("row_status", F.when(F.col("blocked"), "blocked")
                        .when(F.col("status") == "success", "success"))


def live_stats(live: DataFrame) -> DataFrame:
    """Over the live monitor rows."""
    return live.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("blocked")).alias("blocked"),
                    F.avg("latency_ms").alias("avg_latency"), F.count_distinct("user_id").alias("users"))
