"""DuckDB oracles for the event-log and dashboard queries."""

from __future__ import annotations

from .oracle import ORACLE
from .oracle_views import AS_OF_SQL, with_views

EV = ["security_events"]
RQ = ["requests"]
IN = ["incidents", "requests"]


def since(amount: int, unit: str) -> str:
    return f"({AS_OF_SQL} - INTERVAL {amount} {unit})"


ORACLE["events_scan"] = with_views(EV, """
SELECT id, CAST(len(p) AS BIGINT) AS n_patterns, array_to_string(p, ',') AS patterns,
       json_extract_string(metadata, '$.k') AS metadata_k
FROM (SELECT *, CASE WHEN detected_patterns IS NULL THEN NULL
                     WHEN json_valid(detected_patterns) THEN from_json(detected_patterns, '["VARCHAR"]')
                     ELSE CAST([] AS VARCHAR[]) END AS p
      FROM security_events)""")

ORACLE["requests_view"] = with_views(RQ, "SELECT * FROM requests")
ORACLE["incidents_view"] = with_views(["incidents"], "SELECT * FROM incidents")

ORACLE["overview_kpis"] = with_views(RQ, f"""
SELECT CAST(count(*) AS BIGINT) AS total_requests,
       CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS blocked_requests,
       round(coalesce(avg(latency_ms), 0), 6) AS avg_latency,
       CAST(count(DISTINCT threat_type) FILTER (WHERE blocked AND threat_type IS NOT NULL) AS BIGINT) AS unique_threats,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE blocked) / count(*) * 100 ELSE 0 END, 6) AS block_rate
FROM requests WHERE timestamp > {since(168, 'HOUR')}""")

ORACLE["requests_hourly"] = with_views(RQ, f"""
SELECT date_trunc('hour', timestamp) AS hour,
       CAST(count(*) FILTER (WHERE blocked = TRUE) AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE blocked = FALSE) AS BIGINT) AS allowed
FROM requests WHERE timestamp > {since(24, 'HOUR')} GROUP BY 1""")

ORACLE["threat_distribution"] = with_views(RQ, f"""
SELECT threat_type, count, round(count * 100.0 / sum(count) OVER (), 6) AS pct
FROM (SELECT threat_type, CAST(count(*) AS BIGINT) AS count FROM requests
      WHERE blocked AND threat_type IS NOT NULL AND timestamp > {since(168, 'HOUR')} GROUP BY 1)""")

ORACLE["latency_hourly"] = with_views(RQ, f"""
SELECT date_trunc('hour', timestamp) AS hour, round(avg(latency_ms), 6) AS avg_latency,
       min(latency_ms) AS min_latency, max(latency_ms) AS max_latency
FROM requests WHERE timestamp > {since(24, 'HOUR')} GROUP BY 1""")

ORACLE["top_users"] = with_views(RQ, f"""
SELECT user_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS blocked,
       round(avg(latency_ms), 1) AS avg_latency
FROM requests WHERE timestamp > {since(168, 'HOUR')}
GROUP BY user_id ORDER BY total DESC, user_id LIMIT 5""")

INCIDENT_LIST_SQL = f"""
SELECT i.id, i.timestamp, i.threat_type, i.severity, i.prompt_snippet, i.action_taken, r.user_id
FROM incidents i LEFT JOIN requests r ON i.request_id = r.id
WHERE i.timestamp > {since(7, 'DAY')}
  AND i.severity IN ('critical', 'high')
  AND i.threat_type IN ('prompt_injection', 'pii_leak', 'data_exfiltration', 'jailbreak')"""

ORACLE["incident_list"] = with_views(IN, INCIDENT_LIST_SQL)

ORACLE["incident_stats"] = with_views(IN, f"""
SELECT CAST(count(*) AS BIGINT) AS total_incidents,
       CAST(count(*) FILTER (WHERE severity IN ('critical', 'high')) AS BIGINT) AS critical_high,
       CAST(count(DISTINCT user_id) AS BIGINT) AS affected_users
FROM ({INCIDENT_LIST_SQL})""")

ORACLE["incident_search"] = with_views(IN, f"""
SELECT * FROM ({INCIDENT_LIST_SQL}) l
WHERE coalesce(contains(lower(CAST(id AS VARCHAR)), 'ignore'), FALSE)
   OR coalesce(contains(lower(CAST(timestamp AS VARCHAR)), 'ignore'), FALSE)
   OR coalesce(contains(lower(threat_type), 'ignore'), FALSE)
   OR coalesce(contains(lower(severity), 'ignore'), FALSE)
   OR coalesce(contains(lower(prompt_snippet), 'ignore'), FALSE)
   OR coalesce(contains(lower(action_taken), 'ignore'), FALSE)
   OR coalesce(contains(lower(user_id), 'ignore'), FALSE)""")

ORACLE["incident_page"] = with_views(IN, f"""
SELECT *, severity IN ('critical', 'high') AS highlight
FROM ({INCIDENT_LIST_SQL}) ORDER BY timestamp DESC, id DESC LIMIT 25 OFFSET 25""")

_LOG_COLS = "id, timestamp, event_type, severity, user_id, session_id, action_taken, processing_time_ms, blocked"

ORACLE["event_page"] = with_views(EV, f"""
SELECT {_LOG_COLS} FROM security_events ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 400""")

ORACLE["incident_pages"] = with_views(IN, f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(CASE WHEN count(*) > 0 THEN (count(*) - 1) // 25 + 1 ELSE 1 END AS BIGINT) AS total_pages
FROM ({INCIDENT_LIST_SQL})""")

ORACLE["incident_detail"] = with_views(IN, """
SELECT i.id, i.timestamp, i.request_id, i.threat_type, i.severity, i.action_taken,
       r.prompt_length, r.response_length, r.latency_ms,
       json_extract_string(i.details, '$.k') AS details_k
FROM incidents i LEFT JOIN requests r ON i.request_id = r.id""")

LIVE_SQL = """
SELECT id, timestamp, user_id, status, threat_type, latency_ms, blocked, llm_provider,
       CASE WHEN blocked THEN 'blocked' WHEN status = 'success' THEN 'success' END AS row_status
FROM requests ORDER BY timestamp DESC, id DESC LIMIT 50"""

ORACLE["live_monitor"] = with_views(RQ, LIVE_SQL)

ORACLE["live_stats"] = with_views(RQ, f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS blocked,
       round(avg(latency_ms), 6) AS avg_latency, CAST(count(DISTINCT user_id) AS BIGINT) AS users
FROM ({LIVE_SQL})""")

ORACLE["overall_stats"] = with_views(EV, f"""
SELECT CAST(count(*) AS BIGINT) AS total_events,
       CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS total_blocked,
       CAST(sum(CASE WHEN event_type = 'prompt_injection' THEN 1 ELSE 0 END) AS BIGINT) AS total_injections,
       CAST(sum(CASE WHEN event_type = 'data_leak' THEN 1 ELSE 0 END) AS BIGINT) AS total_leaks,
       round(avg(processing_time_ms), 6) AS avg_processing_time,
       max(processing_time_ms) AS max_processing_time, min(processing_time_ms) AS min_processing_time
FROM security_events WHERE timestamp >= {since(7, 'DAY')}""")

ORACLE["events_by_type"] = with_views(EV, f"""
SELECT event_type, CAST(count(*) AS BIGINT) AS count
FROM security_events WHERE timestamp >= {since(7, 'DAY')} GROUP BY event_type""")

DAILY_SQL = """
SELECT CAST(timestamp AS DATE) AS date, CAST(count(*) AS BIGINT) AS total_requests,
       CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS blocked_requests,
       CAST(count(*) FILTER (WHERE event_type = 'prompt_injection') AS BIGINT) AS prompt_injections,
       CAST(count(*) FILTER (WHERE event_type = 'data_leak') AS BIGINT) AS data_leaks,
       round(coalesce(avg(processing_time_ms), 0), 6) AS avg_processing_time_ms
FROM security_events GROUP BY 1"""

ORACLE["daily_statistics"] = with_views(EV, DAILY_SQL)

ORACLE["daily_breakdown"] = with_views(EV, f"""
SELECT * FROM ({DAILY_SQL}) WHERE date >= CAST({AS_OF_SQL} AS DATE) - 7""")

ORACLE["threat_summary"] = with_views(EV, f"""
SELECT 24 AS time_window_hours, CAST(count(*) AS BIGINT) AS total_events,
       CAST(coalesce(sum(CASE WHEN blocked THEN 1 ELSE 0 END), 0) AS BIGINT) AS blocked_requests,
       CAST(coalesce(sum(CASE WHEN event_type = 'prompt_injection' THEN 1 ELSE 0 END), 0) AS BIGINT) AS prompt_injections,
       CAST(coalesce(sum(CASE WHEN event_type = 'data_leak' THEN 1 ELSE 0 END), 0) AS BIGINT) AS data_leaks,
       CAST(coalesce(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS BIGINT) AS critical,
       CAST(coalesce(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END), 0) AS BIGINT) AS high,
       CAST(coalesce(sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END), 0) AS BIGINT) AS medium,
       CAST(coalesce(sum(CASE WHEN severity = 'low' THEN 1 ELSE 0 END), 0) AS BIGINT) AS low
FROM security_events WHERE timestamp >= {since(24, 'HOUR')}""")

ORACLE["today_summary"] = with_views(EV, """
SELECT CAST(count(*) AS BIGINT) AS total_today,
       CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS blocked_today,
       CAST(sum(CASE WHEN event_type = 'prompt_injection' THEN 1 ELSE 0 END) AS BIGINT) AS injections_today,
       CAST(sum(CASE WHEN event_type = 'data_leak' THEN 1 ELSE 0 END) AS BIGINT) AS leaks_today,
       CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_today
FROM security_events WHERE CAST(timestamp AS DATE) = DATE '2024-01-30'""")

ORACLE["user_activity"] = with_views(EV, f"""
SELECT user_id, CAST(count(*) AS BIGINT) AS total_requests,
       CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS blocked_requests,
       CAST(sum(CASE WHEN event_type = 'prompt_injection' THEN 1 ELSE 0 END) AS BIGINT) AS injection_attempts,
       round(avg(processing_time_ms), 6) AS avg_processing_time
FROM security_events WHERE timestamp >= {since(7, 'DAY')} GROUP BY user_id""")

ORACLE["outcome_tally"] = with_views(EV, """
SELECT CAST(count(*) AS BIGINT) AS total_requests,
       CAST(count(*) FILTER (WHERE event_type = 'prompt_injection') AS BIGINT) AS blocked_injections,
       CAST(count(*) FILTER (WHERE event_type = 'rate_limit') AS BIGINT) AS rate_limited,
       CAST(count(*) FILTER (WHERE event_type NOT IN ('prompt_injection', 'rate_limit', 'system_error')) AS BIGINT)
         AS successful_normal
FROM security_events""")

EVENT_COLS = ("id, timestamp, event_type, severity, user_id, session_id, action_taken, "
              "processing_time_ms, blocked")

ORACLE["recent_events"] = with_views(EV, f"""
SELECT {EVENT_COLS} FROM security_events
WHERE event_type = 'prompt_injection' AND blocked
ORDER BY timestamp DESC, id DESC LIMIT 50""")

ORACLE["events_by_user"] = with_views(EV, f"""
SELECT {EVENT_COLS} FROM security_events WHERE user_id = 'user_7'
ORDER BY timestamp DESC, id DESC LIMIT 50""")

ORACLE["events_by_user_topk"] = with_views(EV, """
SELECT user_id, id, timestamp, event_type, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS BIGINT) AS rank
  FROM security_events) WHERE rank <= 5""")

ORACLE["rate_limit"] = with_views(EV, """
SELECT id, user_id, date_trunc('day', timestamp) AS window_start,
       row_number() OVER (PARTITION BY user_id, date_trunc('day', timestamp) ORDER BY timestamp, id) <= 2 AS allowed
FROM security_events""")

ORACLE["retention_rewrite"] = with_views(EV, f"""
SELECT {_LOG_COLS.replace("timestamp", "CASE WHEN id % 97 <> 0 THEN timestamp END AS timestamp")}
FROM security_events WHERE id % 97 = 0 OR timestamp >= {since(14, 'DAY')}""")

ORACLE["retention"] = with_views(EV, f"""
SELECT CAST(count(*) FILTER (WHERE timestamp >= {since(14, 'DAY')} OR timestamp IS NULL) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE timestamp < {since(14, 'DAY')}) AS BIGINT) AS deleted
FROM security_events""")

ORACLE["statistics_bundle"] = with_views(EV, f"""
SELECT CAST(7 AS BIGINT) AS period_days, o.total_events, o.total_blocked, o.avg_processing_time,
       t.by_event_type, d.daily_breakdown
FROM (SELECT CAST(count(*) AS BIGINT) AS total_events,
             CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS total_blocked,
             round(avg(processing_time_ms), 6) AS avg_processing_time
      FROM security_events WHERE timestamp >= {since(7, 'DAY')}) o,
     (SELECT string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type || '=' || CAST(n AS VARCHAR))
             AS by_event_type
      FROM (SELECT event_type, count(*) AS n FROM security_events
            WHERE timestamp >= {since(7, 'DAY')} GROUP BY event_type)) t,
     (SELECT string_agg(CAST(date AS VARCHAR) || ':' || CAST(total_requests AS VARCHAR) || ':'
                        || CAST(blocked_requests AS VARCHAR), ',' ORDER BY date DESC) AS daily_breakdown
      FROM ({DAILY_SQL}) WHERE date >= CAST({AS_OF_SQL} AS DATE) - 7) d""")
