"""DuckDB oracles: validation, proxy outcome, policies, evaluation."""

from __future__ import annotations

from ..functions import rules
from ..operators import proxy as PX
from .oracle import ORACLE, inbound_cte, outbound_cte
from .oracle_views import q, sql_list, with_views

_LO_T, _HI_T = rules.MAX_TOKENS_RANGE
_LO_TEMP, _HI_TEMP = rules.TEMPERATURE_RANGE
_N = rules.PROMPT_MAX_CHARS

STRIP = r"regexp_replace(prompt, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"

VALIDATED_SQL = f"""
SELECT request_id, ts, client_id, use_ml, model, max_tokens, temperature,
       CASE WHEN length(prompt) BETWEEN 1 AND {_N} THEN {STRIP} ELSE prompt END AS prompt,
       errors, len(errors) = 0 AS valid
FROM (
  SELECT *, list_filter([
      CASE WHEN prompt IS NULL THEN 'prompt: field required' END,
      CASE WHEN length(prompt) < 1 THEN 'prompt: too short' END,
      CASE WHEN length(prompt) > {_N} THEN 'prompt: longer than {_N} characters' END,
      CASE WHEN length(prompt) BETWEEN 1 AND {_N} AND {STRIP} = '' THEN 'prompt: empty or whitespace only' END,
      CASE WHEN length(model) > {rules.MODEL_MAX_CHARS} THEN 'model: too long' END,
      CASE WHEN length(model) <= {rules.MODEL_MAX_CHARS} AND model <> '' AND NOT list_contains({sql_list(rules.ALLOWED_MODELS)}, model)
           THEN {q('model: must be one of ' + ', '.join(rules.ALLOWED_MODELS))} END,
      CASE WHEN max_tokens < {_LO_T} OR max_tokens > {_HI_T} THEN 'max_tokens: must be in [{_LO_T}, {_HI_T}]' END,
      CASE WHEN temperature < {_LO_TEMP} OR temperature > {_HI_TEMP} THEN 'temperature: must be in [{_LO_TEMP}, {_HI_TEMP}]' END
    ], lambda x: x IS NOT NULL) AS errors
  FROM (
    SELECT request_id, ts, coalesce(client_id, host, 'unknown') AS client_id,
           coalesce(use_ml, FALSE) AS use_ml, prompt,
           coalesce(model, {q(rules.DEFAULT_MODEL)}) AS model,
           coalesce(max_tokens, {rules.DEFAULT_MAX_TOKENS}) AS max_tokens,
           coalesce(temperature, {rules.DEFAULT_TEMPERATURE}) AS temperature
    FROM prompts))"""

ORACLE["validate_requests"] = with_views(["prompts"], """
SELECT request_id, client_id, model, max_tokens, temperature, valid, array_to_string(errors, '; ') AS errors,
       CAST(length(prompt) AS BIGINT) AS prompt_chars
FROM v""", extra=[("v", VALIDATED_SQL)])

LIMITED_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY client_id, date_trunc('minute', ts) ORDER BY ts, request_id)
          <= {rules.MAX_REQUESTS_PER_MINUTE} AS allowed
FROM v WHERE valid"""

SERVED_SQL = f"""
SELECT s.*, CASE WHEN NOT allowed THEN 'rate_limited' WHEN NOT passed THEN 'blocked' ELSE 'served' END AS outcome,
       CASE WHEN allowed AND passed THEN a.text END AS response_raw
FROM s LEFT JOIN (SELECT conv_id * 1000 + turn - 1 AS rid, text FROM conversations WHERE role = 'assistant') a ON a.rid = s.request_id"""

SV_SQL = f"""
SELECT * EXCLUDE (threat_type, confidence, passed),
       threat_type AS in_threat, confidence AS in_conf, passed AS in_passed
FROM ({SERVED_SQL})"""

PROXY_EXTRA = [("v", VALIDATED_SQL), ("lim", LIMITED_SQL), ("s", inbound_cte("lim", "prompt")),
               ("sv", SV_SQL), ("o", outbound_cte("sv", "request_id", "response_raw"))]

WORDS = r"CAST(len(regexp_extract_all({x}, '[^\s\x1c-\x1f]+')) AS BIGINT)"

ORACLE["token_usage"] = with_views(["prompts"], f"""
SELECT request_id AS id, {WORDS.format(x='prompt')} AS prompt_tokens,
       {WORDS.format(x='final_text')} AS completion_tokens,
       (final_text IS NOT NULL AND (passed OR pii_count + secrets_count > 0)) AS redacted
FROM o WHERE outcome = 'served'""", extra=PROXY_EXTRA)

IN_SEVERITY = """CASE WHEN in_conf >= 0.8 THEN 'critical' WHEN in_conf >= 0.6 THEN 'high'
                      WHEN in_conf >= 0.4 THEN 'medium' ELSE 'low' END"""

ORACLE["event_assembly"] = with_views(["prompts"], f"""
SELECT request_id AS id, ts AS timestamp,
       CASE outcome WHEN 'rate_limited' THEN 'rate_limit' WHEN 'blocked' THEN 'prompt_injection'
            ELSE 'normal_request' END AS event_type,
       CASE outcome WHEN 'rate_limited' THEN 'medium' WHEN 'blocked' THEN {IN_SEVERITY} ELSE 'low' END AS severity,
       client_id AS user_id, CAST(request_id AS VARCHAR) AS session_id,
       CASE WHEN outcome = 'rate_limited' THEN substring(prompt, 1, 100) ELSE substring(prompt, 1, 1000) END AS prompt,
       CASE WHEN outcome = 'served' THEN substring(final_text, 1, 1000) END AS response,
       CASE outcome WHEN 'rate_limited' THEN {q(PX.ACTION_RATE_LIMIT)} WHEN 'blocked' THEN {q(PX.ACTION_BLOCKED)} END
         AS action_taken,
       outcome <> 'served' AS blocked,
       (outcome = 'blocked' AND len(primary_patterns) > 0) AS has_patterns
FROM o""", extra=PROXY_EXTRA)

ORACLE["block_reasons"] = with_views(["prompts"], f"""
SELECT request_id, {q(PX.BLOCK_ERROR)} AS error, in_threat AS threat_type,
       {IN_SEVERITY} AS severity,
       CASE in_threat WHEN 'prompt_injection' THEN 'Prompt Injection detected'
            WHEN 'jailbreak' THEN 'Jailbreak detected'
            WHEN 'data_exfiltration' THEN 'Data Exfiltration detected' END AS message
FROM sv WHERE outcome = 'blocked'""", extra=PROXY_EXTRA[:4])

IN_MESSAGE = """CASE in_threat WHEN 'prompt_injection' THEN 'Prompt Injection detected' WHEN 'jailbreak' THEN 'Jailbreak detected'
            WHEN 'data_exfiltration' THEN 'Data Exfiltration detected' END"""

# An answer that is missing has nothing to find: it passes.
ORACLE["audit_metadata"] = with_views(["prompts"], f"""
SELECT request_id AS id, CASE WHEN b THEN array_to_string(primary_patterns, ' ;; ') END AS patterns,
       CASE WHEN s THEN model END AS model, CASE WHEN s THEN NOT coalesce(passed, TRUE) END AS pii_detected, CASE WHEN b OR s THEN FALSE END AS ml_used,
       CASE WHEN b THEN in_conf END AS confidence, CASE WHEN b THEN in_threat END AS threat_type, CASE WHEN b THEN {IN_MESSAGE} END AS message,
       CASE WHEN b THEN array_to_string(list_filter([CASE WHEN ni > 0 THEN 'prompt_injection' END, CASE WHEN nj > 0 THEN 'jailbreak' END,
                                                     CASE WHEN ne > 0 THEN 'data_exfiltration' END], lambda x: x IS NOT NULL), ',') END AS all_threats,
       CASE WHEN b THEN CAST((ni > 0)::INT + (nj > 0)::INT + (ne > 0)::INT AS BIGINT) END AS rule_detections,
       CASE WHEN b THEN FALSE END AS details_ml_used
FROM (SELECT *, outcome = 'blocked' AS b, outcome = 'served' AS s FROM o)""", extra=PROXY_EXTRA)

ORACLE["proxy_responses"] = with_views(["prompts"], f"""
SELECT request_id AS id, model, final_text AS response, {WORDS.format(x='prompt')} AS prompt_tokens,
       {WORDS.format(x='final_text')} AS completion_tokens, in_passed AS prompt_passed, FALSE AS ml_used, coalesce(passed, TRUE) AS response_passed,
       (final_text IS NOT NULL AND (passed OR pii_count + secrets_count > 0)) AS redacted
FROM o WHERE outcome = 'served'""", extra=PROXY_EXTRA)

ORACLE["failure_rows"] = with_views(["prompts"], f"""
SELECT request_id AS id, ts AS timestamp, 'system_error' AS event_type, 'high' AS severity, client_id AS user_id,
       CAST(request_id AS VARCHAR) AS session_id, substring(prompt, 1, 1000) AS prompt, {q(PX.ACTION_ERROR)} AS action_taken,
       TRUE AS blocked, array_to_string(errors, '; ') AS error, 'ValidationError' AS error_type
FROM v WHERE NOT valid""", extra=[("v", VALIDATED_SQL)])

ORACLE["word_counts"] = f"""
SELECT conv_id, turn, {WORDS.format(x='text')} AS n_words FROM conversations"""


# ------------------------------------------------------------- policies

_POL_VALUES = ", ".join(f"({i + 1}, {q(n)}, {q(t)}, {q(c)})" for i, (n, t, c) in enumerate(rules.DEFAULT_POLICIES))
POLICY_PATTERNS_SQL = f"""
SELECT name, type, pats[i] AS pattern, i AS ord
FROM (SELECT name, type, from_json(config, '{{"patterns":["VARCHAR"]}}').patterns AS pats
      FROM (VALUES {_POL_VALUES}) t(id, name, type, config) WHERE json_valid(config)),
     unnest(range(1, coalesce(len(pats), 0) + 1)) AS r(i)
WHERE pats[i] IS NOT NULL AND pats[i] <> ''"""

ORACLE["policy_match"] = with_views(["prompts", "responses"], """
SELECT source, row_id, policy, CAST(count(*) AS BIGINT) AS n_matched, string_agg(pattern, ',' ORDER BY ord) AS matched
FROM (
  SELECT 'prompts' AS source, p.request_id AS row_id, pp.name AS policy, pp.pattern, pp.ord
  FROM prompts p JOIN pp ON pp.type = 'input' AND contains(lower(p.prompt), lower(pp.pattern))
  UNION ALL
  SELECT 'responses', r.id, pp.name, pp.pattern, pp.ord
  FROM responses r JOIN pp ON pp.type = 'output' AND contains(lower(r.text), lower(pp.pattern)))
GROUP BY source, row_id, policy""", extra=[("pp", POLICY_PATTERNS_SQL)])

SNAPSHOT_SQL = """
SELECT name, any_value(c_type) AS type,
       coalesce(any_value(config) FILTER (WHERE upd AND rk_upd = 1), any_value(c_config)) AS config,
       coalesce(any_value(enabled) FILTER (WHERE tog AND rk_tog = 1), TRUE) AS enabled,
       greatest(any_value(c_ts), coalesce(max(ts) FILTER (WHERE upd OR tog), any_value(c_ts))) AS last_updated,
       CAST(count(*) FILTER (WHERE rejected) AS BIGINT) AS n_rejected
FROM (
  SELECT *, row_number() OVER (PARTITION BY name, upd ORDER BY ts DESC, change_id DESC) AS rk_upd,
            row_number() OVER (PARTITION BY name, tog ORDER BY ts DESC, change_id DESC) AS rk_tog
  FROM (
    SELECT p.*, cr.c_type, cr.c_config, cr.c_ts,
           coalesce(cr.name IS NOT NULL AND (p.ts > cr.c_ts OR (p.ts = cr.c_ts AND p.change_id > cr.c_id)), FALSE) AS after,
           coalesce(json_valid(p.config), FALSE) AS vj
    FROM policy_changes p JOIN (
      SELECT name, type AS c_type, config AS c_config, ts AS c_ts, change_id AS c_id FROM (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, change_id) AS rn
        FROM policy_changes WHERE op = 'create' AND coalesce(json_valid(config), FALSE)) WHERE rn = 1) cr
    ON p.name = cr.name) x,
  LATERAL (SELECT x.after AND x.op = 'update' AND x.vj AS upd, x.after AND x.op = 'toggle' AS tog,
                  (x.op = 'create' AND NOT x.vj) OR (x.op = 'create' AND x.after) OR (x.op = 'update' AND NOT x.vj) AS rejected) f
)
GROUP BY name"""

ORACLE["policy_snapshot"] = with_views(["policy_changes"], SNAPSHOT_SQL)

ORACLE["policies_scan"] = with_views(["policy_changes"], f"""
SELECT name, type, enabled, coalesce(json_valid(config), FALSE) AS config_valid,
       CASE WHEN json_valid(config) THEN TRY_CAST(json_extract(config, '$.threshold') AS DOUBLE) END AS threshold
FROM ({SNAPSHOT_SQL})""")

ORACLE["policy_texts"] = with_views(["policy_changes"], """
SELECT change_id, coalesce(json_valid(config), FALSE) AS config_valid,
       CASE WHEN json_valid(config) THEN '{' || chr(10) || '  ' || config[2:-2] || chr(10) || '}' ELSE config END AS config_display
FROM policy_changes""")

# ------------------------------------------------------------- entities

_PERSON_START = "length('Order ' || CAST(o_orderkey AS VARCHAR) || ' for ')"
ENTITY_ROWS_SQL = f"""
SELECT note_id, 'PERSON' AS type, {_PERSON_START} AS st, c_name AS match FROM order_notes
UNION ALL
SELECT note_id, 'GPE', {_PERSON_START} + length(c_name) + 4, n_name FROM order_notes
UNION ALL
SELECT note_id, 'LOC', {_PERSON_START} + length(c_name) + 4 + length(n_name) + 2, r_name FROM order_notes"""

ORACLE["gazetteer_spans"] = with_views(["order_notes"], f"""
SELECT note_id, type, CAST(st AS BIGINT) AS start, CAST(st + length(match) AS BIGINT) AS "end", match
FROM ({ENTITY_ROWS_SQL})""")

ORACLE["date_time_spans"] = """
WITH n AS (SELECT o_orderkey AS note_id, length('Order ' || o_orderkey || ' placed ') AS pos,
                  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y')
                       ELSE strftime(o_orderdate, '%B %-d, %Y') END AS d,
                  lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS t FROM orders)
SELECT note_id, 'DATE' AS type, CAST(pos AS BIGINT) AS start, CAST(pos + length(d) AS BIGINT) AS "end", d AS match FROM n WHERE d IS NOT NULL
UNION ALL
SELECT note_id, 'TIME', pos + length(d) + 4, pos + length(d) + 9, t FROM n WHERE d IS NOT NULL"""

ORACLE["supply_entities"] = """
WITH n AS (SELECT CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey * 10 + l_linenumber END AS note_id, s_name, strftime(l_shipdate, '%Y-%m-%d') AS d,
                  lpad(CAST(l_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_orderkey % 60 AS VARCHAR), 2, '0') AS t
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT note_id, 'ORG' AS type, CAST(5 AS BIGINT) AS start, CAST(5 + length(s_name) AS BIGINT) AS "end", s_name AS match FROM n WHERE d IS NOT NULL
UNION ALL
SELECT note_id, 'DATE', 9 + length(s_name), 19 + length(s_name), d FROM n WHERE d IS NOT NULL
UNION ALL
SELECT note_id, 'TIME', 23 + length(s_name), 28 + length(s_name), t FROM n WHERE d IS NOT NULL"""

ORACLE["name_match"] = with_views(["order_notes"], """
SELECT note_id, 'customers' AS name, c_custkey AS ordinal, c.c_name AS pattern
FROM order_notes n JOIN customer c ON c.c_name = n.c_name""")

ORACLE["redact_notes"] = with_views(["order_notes"], """
SELECT note_id, 'pii_leak' AS threat_type, 'medium' AS severity, CAST(3 AS BIGINT) AS pii_count,
       'PERSON,GPE,LOC' AS matched_types,
       'Order ' || CAST(o_orderkey AS VARCHAR) || ' for [REDACTED_NAME] in [REDACTED_LOCATION], [REDACTED_LOCATION]'
         || ': status ' || o_orderstatus || ', priority ' || o_orderpriority AS final_text
FROM order_notes""")

# ------------------------------------------------------------- evaluation

ORACLE["latency_stats"] = with_views(["inference_log"], """
SELECT CAST(count(x) AS BIGINT) AS count, round(avg(x), 2) AS mean_ms, round(median(x), 2) AS median_ms,
       round(quantile_cont(x, 0.95), 2) AS p95_ms, round(min(x), 2) AS min_ms, round(max(x), 2) AS max_ms
FROM (SELECT inference_time_ms AS x FROM inference_log ORDER BY ts DESC, event_id DESC LIMIT 100)""")

ORACLE["roc_curve"] = with_views(["scored"], """
SELECT label_name, score, round(fp / N, 9) AS fpr, round(tp / P, 9) AS tpr
FROM (SELECT label_name, score, sum(pos) OVER (PARTITION BY label_name ORDER BY score DESC) AS tp,
             sum(neg) OVER (PARTITION BY label_name ORDER BY score DESC) AS fp
      FROM (SELECT label_name, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
            FROM scored GROUP BY label_name, score))
JOIN (SELECT label_name, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label <> 1) AS N FROM scored GROUP BY label_name)
     USING (label_name)
UNION ALL
SELECT DISTINCT label_name, NULL, 0.0, 0.0 FROM scored""")

# Mann-Whitney form: mean rank of the positives, ties at their middle.
ORACLE["roc_auc"] = with_views(["scored"], """
SELECT label_name, round((sum(r) FILTER (WHERE label = 1) - P * (P + 1) / 2) / (P * N), 9) AS auc,
       CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives
FROM (SELECT label_name, label, rank() OVER (PARTITION BY label_name ORDER BY score)
             + (count(*) OVER (PARTITION BY label_name, score) - 1) / 2.0 AS r FROM scored WHERE label IS NOT NULL)
JOIN (SELECT label_name, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label <> 1) AS N FROM scored GROUP BY label_name)
     USING (label_name)
GROUP BY label_name, P, N""")

ORACLE["roc_store"] = f"""
SELECT label_name AS label, CAST(row_number() OVER (PARTITION BY label_name ORDER BY fpr, tpr) - 1 AS BIGINT) AS i,
       fpr, tpr, auc AS stored_auc
FROM (SELECT label_name, CAST(floor(score * 200) AS BIGINT) AS step, max(fpr) AS fpr, max(tpr) AS tpr
      FROM ({ORACLE["roc_curve"]}) GROUP BY ALL)
JOIN ({ORACLE["roc_auc"]}) USING (label_name)"""

ORACLE["stored_actions"] = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'prompt_injection' WHEN quality = 0 THEN 'sensitive_data' ELSE 'benign' END AS label,
       CASE WHEN toxic = 1 THEN 'block' WHEN quality = 0 THEN 'redact' END AS action
FROM labels"""

ORACLE["label_actions"] = with_views(["prompts", "responses"], """
SELECT source, row_id, label, CASE label WHEN 'prompt_injection' THEN 'block' WHEN 'sensitive_data' THEN 'redact' END AS action
FROM (
  SELECT 'prompts' AS source, request_id AS row_id, 'prompt_injection' AS label FROM si WHERE NOT passed
  UNION ALL
  SELECT 'responses', _id, 'sensitive_data' FROM so WHERE threat_type IN ('api_key_leak', 'pii_leak'))""",
    extra=[("si", inbound_cte("prompts", "prompt")), ("so", outbound_cte("responses", "id", "text"))])

# ------------------------------------------------------------- streaming (stream = batch)

ORACLE["stream_inbound"] = ORACLE["inbound_scan"]
ORACLE["stream_redact"] = ORACLE["redact_documents"]
ORACLE["stream_rate_limit"] = ORACLE["rate_limit"]
ORACLE["stream_audit"] = ORACLE["event_assembly"]
ORACLE["stream_live"] = ORACLE["live_monitor"]
ORACLE["stream_daily_stats"] = ORACLE["daily_statistics"]

ORACLE["stream_replay"] = with_views(["security_events"], """
SELECT id, user_id, event_type, blocked, timestamp FROM security_events""")

ORACLE["stream_client_minutes"] = with_views(["security_events"], """
SELECT date_trunc('minute', timestamp) AS window_start, user_id, CAST(count(*) AS BIGINT) AS requests
FROM security_events GROUP BY 1, 2""")

ORACLE["stream_hourly"] = with_views(["requests"], """
SELECT date_trunc('hour', timestamp) AS hour,
       CAST(count(*) FILTER (WHERE blocked = TRUE) AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE blocked = FALSE) AS BIGINT) AS allowed,
       round(avg(latency_ms), 6) AS avg_latency, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency
FROM requests GROUP BY 1""")

ORACLE["audit_append"] = ORACLE["event_assembly"]
from .oracle_events import IN, INCIDENT_LIST_SQL  # noqa: E402
ORACLE["incidents_export"] = with_views(IN, INCIDENT_LIST_SQL)
