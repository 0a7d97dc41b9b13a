"""DuckDB SQL twins of ``vigilspark.sources.fixtures`` views.

The driver pre-registers the raw tables as DuckDB views; every oracle query is
``WITH <needed views> <body>``.  Literals are generated from the same fixed
values the Spark views use; the logic is written independently in SQL.
"""

from __future__ import annotations

from ..functions import rules
from ..sources import fixtures as FX


def q(s: str) -> str:
    """SQL string literal (standard quoting; backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


AS_OF_SQL = f"TIMESTAMP {q(FX.AS_OF)}"

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

VIEWS["prompts"] = f"""
SELECT conv_id * 1000 + turn AS request_id,
       TIMESTAMP {q(FX.EPOCH)} + to_seconds(CASE WHEN conv_id % 5 IN (1, 3) THEN (conv_id // 300) * 3600 + turn % 60 ELSE conv_id * 1000 + turn END) AS ts,
       CASE WHEN conv_id % 13 = 0 THEN NULL WHEN conv_id % 5 IN (1, 3) THEN 'client_3' ELSE 'client_' || CAST(conv_id % 7 AS VARCHAR) END AS client_id,
       CASE WHEN conv_id % 26 = 0 THEN NULL ELSE '10.0.' || CAST(conv_id % 5 AS VARCHAR) || '.1' END AS host,
       CASE WHEN conv_id % 5 = 0 THEN FALSE ELSE NULL END AS use_ml,
       CASE WHEN (conv_id + turn) % 3 = 0
            THEN ({sql_list(FX.PINNED_PROMPTS)})[1 + conv_id % 23] || ' ' || text
            ELSE text END AS prompt,
       CASE WHEN conv_id % 11 = 0 THEN 'invalid-model'
            ELSE ({sql_list(rules.ALLOWED_MODELS)})[1 + conv_id % 4] END AS model,
       CAST(CASE WHEN conv_id % 20 = 19 THEN 5000 ELSE 500 + (conv_id % 70) * 50 END AS INTEGER) AS max_tokens,
       CAST(conv_id % 10 AS DOUBLE) / 4 AS temperature
FROM conversations WHERE role = 'user'"""

VIEWS["responses"] = f"""
SELECT doc_id AS id,
       CASE WHEN doc_id % 10 = 0
            THEN ({sql_list(FX.SPLICE_TEXTS)})[1 + (doc_id // 10) % {len(FX.SPLICE_TEXTS)}] || ' ' || text
            ELSE text END AS text,
       lang, source
FROM documents"""

VIEWS["tangled_responses"] = f"""
SELECT doc_id AS id,
       CASE WHEN doc_id % 4 = 0
            THEN ({sql_list(FX.TANGLED_TEXTS)})[1 + (doc_id // 4) % {len(FX.TANGLED_TEXTS)}] || ' ' || coalesce(text, '') || ' '
                 || ({sql_list(FX.TANGLED_TEXTS)})[1 + (doc_id // 4 + 3) % {len(FX.TANGLED_TEXTS)}]
            ELSE text END AS text
FROM documents"""

VIEWS["rule_prompts"] = f"""
SELECT conv_id * 1000 + turn AS request_id,
       CASE WHEN (conv_id * 7 + turn) % {len(FX.RULE_PHRASES) + 1} = {len(FX.RULE_PHRASES)} THEN text
            ELSE ({sql_list(FX.RULE_PHRASES)})[1 + (conv_id * 7 + turn) % {len(FX.RULE_PHRASES) + 1}] || '. ' || coalesce(text, '') END AS prompt,
       (conv_id + turn) % 5 <> 0 AS use_ml, conv_id % 3 <> 0 AS ml_malicious,
       CAST((conv_id * 13 + turn) % 101 AS DOUBLE) / 100 AS ml_confidence
FROM conversations WHERE role = 'user'"""

VIEWS["pairs"] = f"""
SELECT u.conv_id AS conv_id, u.turn AS turn,
       CASE WHEN (u.conv_id + u.turn) % 3 = 0
            THEN ({sql_list(FX.PINNED_PROMPTS)})[1 + u.conv_id % 23] || ' ' || u.text
            ELSE u.text END AS prompt,
       CASE WHEN (u.conv_id + a.turn) % 5 = 0
            THEN ({sql_list(FX.SPLICE_TEXTS)})[1 + u.conv_id % {len(FX.SPLICE_TEXTS)}] || ' ' || a.text
            ELSE a.text END AS response
FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""

_type_case = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FX.EVENT_TYPE_MAP.items())
VIEWS["security_events"] = f"""
SELECT event_id AS id,
       ts AS timestamp,
       CASE event_type {_type_case} ELSE 'normal_request' END AS event_type,
       CASE WHEN value >= 120 THEN 'critical' WHEN value >= 70 THEN 'high'
            WHEN value >= 35 THEN 'medium' ELSE 'low' END AS severity,
       'user_' || CAST(user_id AS VARCHAR) AS user_id,
       'sess_' || CAST(event_id AS VARCHAR) AS session_id,
       CASE WHEN event_type = 'click' THEN ({sql_list(FX.PINNED_PROMPTS)})[1 + event_id % 23]
            ELSE 'request ' || CAST(event_id AS VARCHAR) END AS prompt,
       CASE WHEN event_type = 'view' THEN 'response ' || CAST(event_id AS VARCHAR) END AS response,
       CASE WHEN event_type = 'click' THEN '["ignore_rule", "rule_' || CAST(event_id % 5 AS VARCHAR) || '"]'
            WHEN event_type = 'error' AND event_id % 3 = 0 THEN '[not json' END AS detected_patterns,
       CASE WHEN event_type = 'click' THEN 'Request blocked' WHEN event_type = 'signup' THEN 'Rate limit exceeded'
            WHEN event_type = 'error' THEN 'Internal error' END AS action_taken,
       value AS processing_time_ms,
       props AS metadata,
       event_type IN ({", ".join(q(x) for x in FX.BLOCKED_SOURCE_TYPES)}) AS blocked
FROM events"""

# Dashboard tables derived from the event log.
THREAT_OF_EVENT_SQL = """CASE event_type
            WHEN 'prompt_injection' THEN coalesce(json_extract_string(metadata, '$.threat_type'), 'prompt_injection')
            WHEN 'data_leak' THEN 'pii_leak'
            WHEN 'rate_limit' THEN 'rate_limit'
            WHEN 'system_error' THEN 'system_error' END"""
VIEWS["requests"] = f"""
SELECT id, timestamp, user_id,
       CAST(length(prompt) AS INTEGER) AS prompt_length,
       CAST(length(response) AS INTEGER) AS response_length,
       processing_time_ms AS latency_ms,
       CASE WHEN blocked THEN 'blocked' ELSE 'success' END AS status,
       {THREAT_OF_EVENT_SQL} AS threat_type,
       blocked,
       json_extract_string(metadata, '$.model') AS llm_provider
FROM security_events"""
DEPS["requests"] = ["security_events"]

VIEWS["incidents"] = f"""
SELECT id, timestamp, id AS request_id,
       {THREAT_OF_EVENT_SQL} AS threat_type,
       severity,
       substring(prompt, 1, 100) AS prompt_snippet,
       substring(response, 1, 100) AS response_snippet,
       action_taken,
       metadata AS details
FROM security_events WHERE blocked"""
DEPS["incidents"] = ["security_events"]

VIEWS["scored"] = """
SELECT doc_id AS id, 'toxic' AS label_name, CAST(toxic AS INTEGER) AS label,
       (10000 * length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) // greatest(length(text), 1)) / 10000.0::DOUBLE AS score
FROM labels JOIN documents USING (doc_id)
UNION ALL
SELECT doc_id, 'quality', CAST(quality AS INTEGER),
       (10000 * length(regexp_replace(text, '[^a-z]', '', 'g')) // greatest(length(text), 1)) / 10000.0::DOUBLE
FROM labels JOIN documents USING (doc_id)"""

VIEWS["inference_log"] = """
SELECT event_id, ts, value AS inference_time_ms FROM events"""

VIEWS["policy_changes"] = """
SELECT event_id AS change_id,
       'policy_' || CAST(user_id % 40 AS VARCHAR) AS name,
       CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'click' THEN 'update' ELSE 'toggle' END AS op,
       CASE WHEN user_id % 2 = 0 THEN 'input' ELSE 'output' END AS type,
       CASE WHEN event_type = 'purchase' THEN NULL
            WHEN event_id % 17 = 0 THEN '{bad json'
            ELSE '{"threshold": ' || CAST(value AS VARCHAR) || '}' END AS config,
       event_id % 2 = 0 AS enabled,
       ts
FROM events WHERE event_type IN ('signup', 'click', 'purchase')"""


def with_views(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body

VIEWS["order_notes"] = """
SELECT o.o_orderkey AS note_id,
       'Order ' || CAST(o.o_orderkey AS VARCHAR) || ' for ' || c.c_name || ' in ' || n.n_name || ', ' || r.r_name
         || ': status ' || o.o_orderstatus || ', priority ' || o.o_orderpriority AS text,
       o.o_orderkey, c.c_name, n.n_name, r.r_name, o.o_orderstatus, o.o_orderpriority
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
