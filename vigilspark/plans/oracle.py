"""DuckDB oracle SQL per registered query (same column names as the Spark side).

Regex semantics: the Spark side uses java.util.regex with Unicode classes, the
oracle RE2; on the driver's tables they agree (see SURVEY §4.3).  Redaction is
checked with chained ``regexp_replace`` (valid because no spans overlap in these
tables), span offsets with ``string_split_regex`` prefix sums, rule matches with
``regexp_matches`` — independent formulations of the same semantics.
"""

from __future__ import annotations

from ..functions import rules
from .oracle_views import q, with_views

ORACLE: dict[str, str] = {}

PII = [(n, rules.re2_regex(p, False)) for n, p in rules.PII_PATTERNS]
SEC = [(n, rules.re2_regex(p, ic)) for n, p, ic in rules.SECRET_PATTERNS]
ALL = PII + SEC


def oracle_sql() -> dict[str, str]:
    from . import oracle_events, oracle_more  # noqa: F401
    return dict(ORACLE)


def _rx_all(text: str, pat: str) -> str:
    return f"regexp_extract_all({text}, {q(pat)})"


def _count_sum(text: str, pats) -> str:
    return "CAST(" + " + ".join(f"len({_rx_all(text, p)})" for _, p in pats) + " AS BIGINT)"


def _redact_chain(text: str) -> str:
    expr = text
    for n, p in ALL:
        tpl = rules.REDACTION_TEMPLATES.get(n, rules.DEFAULT_TEMPLATE)
        expr = f"regexp_replace({expr}, {q(p)}, {q(tpl)}, 'g')"
    return expr


def outbound_cte(src: str, id_col: str, text_col: str) -> str:
    """Per-row counts + verdict columns for an outbound scan of ``src``."""
    return f"""
SELECT *,
  CASE WHEN secrets_count > 0 THEN 'api_key_leak' WHEN pii_count > 0 THEN 'pii_leak'
       WHEN excessive_length THEN 'excessive_output' ELSE 'clean' END AS threat_type,
  CASE WHEN secrets_count > 0 THEN 'critical'
       WHEN pii_count > 0 THEN (CASE WHEN pii_count + secrets_count > 3 THEN 'high' ELSE 'medium' END)
       WHEN excessive_length THEN 'medium' ELSE 'low' END AS severity,
  CAST(CASE WHEN secrets_count > 0 THEN 0.95 WHEN pii_count > 0 THEN 0.85
       WHEN excessive_length THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence,
  (secrets_count = 0 AND pii_count = 0 AND NOT excessive_length) AS passed,
  CASE WHEN pii_count + secrets_count > 0 THEN {_redact_chain('_t')} ELSE _t END AS final_text
FROM (
  SELECT *, {_count_sum('_t', PII)} AS pii_count, {_count_sum('_t', SEC)} AS secrets_count,
         coalesce(length(_t) / 4 > {rules.MAX_RESPONSE_TOKENS}, FALSE) AS excessive_length
  FROM (SELECT *, {id_col} AS _id, {text_col} AS _t FROM {src})
)"""


ORACLE["redact_documents"] = with_views(["responses"], """
SELECT _id AS doc_id, threat_type, severity, confidence, pii_count, secrets_count,
       pii_count + secrets_count AS n_findings, excessive_length, passed, final_text
FROM o""", extra=[("o", outbound_cte("responses", "id", "text"))])

ORACLE["redact_merged"] = with_views(["responses"], """
SELECT _id AS doc_id, final_text FROM o""", extra=[("o", outbound_cte("responses", "id", "text"))])


def _types_list(text: str) -> str:
    return "flatten([" + ", ".join(
        f"list_transform({_rx_all(text, p)}, lambda x: {q(n)})" for n, p in ALL) + "])"


def _matches_list(text: str) -> str:
    return "flatten([" + ", ".join(_rx_all(text, p) for _, p in ALL) + "])"


ORACLE["outbound_scan"] = with_views(["responses"], f"""
SELECT _id AS doc_id, threat_type, severity, confidence,
  CASE WHEN passed THEN 'No sensitive data detected'
       ELSE 'Detected ' || CAST(pii_count + secrets_count AS VARCHAR) || ' sensitive items' END AS message,
  array_to_string({_types_list('_t')}, ',') AS matched_types,
  array_to_string(list_transform(list_slice({_matches_list('_t')}, 1, 10),
      lambda x: CASE WHEN length(x) > 50 THEN substring(x, 1, 50) || '...' ELSE x END), ' | ') AS finding_previews,
  (passed OR pii_count + secrets_count > 0) AS redacted
FROM o""", extra=[("o", outbound_cte("responses", "id", "text"))])


def _spans_sql(src: str, pats) -> str:
    parts = []
    for n, p in pats:
        parts.append(f"""
SELECT id AS doc_id, {q(n)} AS type, CAST(st AS BIGINT) AS start, CAST(st + length(match) AS BIGINT) AS "end", match
FROM (
  SELECT id, m[i] AS match,
         coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT id, {_rx_all('text', p)} AS m, string_split_regex(text, {q(p)}) AS g FROM {src})
        WHERE len(m) > 0)
)""")
    return "\nUNION ALL\n".join(parts)


# Unions of overlapping spans by a running maximum of ends, then the text between them
_TPL = "CASE type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.REDACTION_TEMPLATES.items()) + f" ELSE {q(rules.DEFAULT_TEMPLATE)} END"
_RANK = "CASE type " + " ".join(f"WHEN {q(n)} THEN {k}" for k, (n, _) in enumerate(ALL)) + " END"
ORACLE["redact_overlaps"] = with_views(["tangled_responses"], """
SELECT t.id AS doc_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_findings,
       CASE WHEN r.n IS NULL THEN t.text ELSE r.head || substring(t.text, CAST(r.upto AS BIGINT) + 1) END AS final_text
FROM tangled_responses t LEFT JOIN (
  SELECT u.doc_id, sum(n) AS n, max(e) AS upto,
         string_agg(substring(t2.text, CAST(before AS BIGINT) + 1, CAST(s - before AS BIGINT)) || tpl, '' ORDER BY s) AS head
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM unions) u
  JOIN tangled_responses t2 ON t2.id = u.doc_id GROUP BY u.doc_id) r ON r.doc_id = t.id""", extra=[
    ("spans", _spans_sql("tangled_responses", ALL)),
    ("swept", f"""SELECT *, {_RANK} AS rk, {_TPL} AS tpl,
       coalesce(start >= max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, {_RANK}
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fresh FROM spans"""),
    ("grouped", """SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rk) AS g FROM swept"""),
    ("unions", """SELECT doc_id, g, count(*) AS n, min(start) AS s, max("end") AS e, arg_min(tpl, start * 1000000 - "end" + rk / 100.0) AS tpl
                  FROM grouped GROUP BY doc_id, g""")])

ORACLE["pii_spans"] = with_views(["responses"], _spans_sql("responses", PII))
ORACLE["secret_spans"] = with_views(["responses"], _spans_sql("responses", SEC))


def _profile(src_name: str, src: str, text_col: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(src_name)} AS source, {q(n)} AS type, CAST(sum(len({_rx_all(text_col, p)})) AS BIGINT) AS n_findings FROM {src}"
        for n, p in ALL)


ORACLE["findings_profile"] = with_views(["responses"], f"""
SELECT * FROM (
{_profile('responses', 'responses', 'text')}
UNION ALL
{_profile('pages', 'pages', 'html')}
) WHERE n_findings > 0""")

ORACLE["excess_output"] = with_views(["responses"], f"""
SELECT id AS doc_id, length(text) / 4 AS estimated_tokens, length(text) / 4 > {rules.MAX_RESPONSE_TOKENS} AS excessive
FROM responses""")


# ------------------------------------------------------------------ inbound

def _matched_list(text: str, pats) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({text}, {q(rules.re2_regex(p, True))}) THEN {q(p)} END"
                      for p in pats)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _conf(n: str, family: str) -> str:
    base, step = rules.RULE_CONFIDENCE[family]
    return (f"CASE WHEN {n} > 0 THEN least(CAST({n} AS DOUBLE) * CAST({step} AS DOUBLE) + CAST({base} AS DOUBLE), "
            f"CAST(1.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END")


def inbound_cte(src: str, text_col: str) -> str:
    return f"""
SELECT *,
  CASE WHEN ni > 0 AND ci >= cj AND ci >= ce THEN 'prompt_injection'
       WHEN nj > 0 AND cj >= ce THEN 'jailbreak'
       WHEN ne > 0 THEN 'data_exfiltration' ELSE 'clean' END AS threat_type,
  CASE WHEN ni > 0 AND ci >= cj AND ci >= ce THEN ci
       WHEN nj > 0 AND cj >= ce THEN cj
       WHEN ne > 0 THEN ce ELSE CAST(1.0 AS DOUBLE) END AS confidence,
  CASE WHEN ni > 0 AND ci >= cj AND ci >= ce THEN inj
       WHEN nj > 0 AND cj >= ce THEN jb
       WHEN ne > 0 THEN ex ELSE [] END AS primary_patterns,
  (ni = 0 AND nj = 0 AND ne = 0) AS passed
FROM (
  SELECT *, {_conf('ni', 'prompt_injection')} AS ci, {_conf('nj', 'jailbreak')} AS cj,
         {_conf('ne', 'data_exfiltration')} AS ce
  FROM (
    SELECT *, len(inj) AS ni, len(jb) AS nj, len(ex) AS ne
    FROM (
      SELECT *, {_matched_list(text_col, rules.INJECTION_PATTERNS)} AS inj,
             {_matched_list(text_col, rules.JAILBREAK_PATTERNS)} AS jb,
             {_matched_list(text_col, rules.EXFILTRATION_PATTERNS)} AS ex
      FROM {src})))"""


SEVERITY_SQL = """CASE WHEN passed THEN 'low' WHEN confidence >= 0.8 THEN 'critical'
       WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END"""
MESSAGE_SQL = """CASE threat_type WHEN 'clean' THEN 'No threats detected'
       WHEN 'prompt_injection' THEN 'Prompt Injection detected'
       WHEN 'jailbreak' THEN 'Jailbreak detected'
       WHEN 'data_exfiltration' THEN 'Data Exfiltration detected' END"""

for fam, lst, n, c in [("inbound_injection", "inj", "ni", "ci"), ("inbound_jailbreak", "jb", "nj", "cj"),
                       ("inbound_exfiltration", "ex", "ne", "ce")]:
    ORACLE[fam] = with_views(["prompts"], f"""
SELECT request_id, array_to_string({lst}, ' ;; ') AS matched, CAST({n} AS BIGINT) AS n_matched, {c} AS confidence
FROM s""", extra=[("s", inbound_cte("prompts", "prompt"))])

ORACLE["inbound_scan"] = with_views(["prompts"], f"""
SELECT request_id, passed, threat_type, {SEVERITY_SQL} AS severity, confidence, {MESSAGE_SQL} AS message,
  array_to_string(primary_patterns, ' ;; ') AS matched,
  array_to_string(list_filter([CASE WHEN ni > 0 THEN 'prompt_injection' END, CASE WHEN nj > 0 THEN 'jailbreak' END,
                               CASE WHEN ne > 0 THEN 'data_exfiltration' END], lambda x: x IS NOT NULL), ',') AS all_threats,
  CASE WHEN passed THEN NULL ELSE CAST((ni > 0)::INT + (nj > 0)::INT + (ne > 0)::INT AS BIGINT) END AS rule_detections
FROM s""", extra=[("s", inbound_cte("prompts", "prompt"))])

ORACLE["inbound_rules"] = with_views(["rule_prompts"], "\nUNION ALL\n".join(
    f"SELECT request_id, {q(f)} AS threat, {q(p)} AS rule FROM rule_prompts WHERE regexp_matches(prompt, {q(rules.re2_regex(p, True))})"
    for f, pats in rules.RULE_SETS.items() for p in pats))

_ML_WINS = "ml_prediction IS NOT NULL AND (rules_passed OR ml_confidence > rule_confidence)"
ORACLE["ml_verdicts"] = with_views(["rule_prompts"], f"""
SELECT request_id, passed, threat_type, {SEVERITY_SQL} AS severity, confidence, matched, all_threats, ml_prediction,
       CASE WHEN passed THEN NULL ELSE rule_families END AS rule_detections
FROM (SELECT request_id, ml_prediction, rule_families, rules_passed AND ml_prediction IS NULL AS passed,
             CASE WHEN {_ML_WINS} THEN ml_prediction ELSE rule_threat END AS threat_type,
             CASE WHEN {_ML_WINS} THEN ml_confidence ELSE rule_confidence END AS confidence,
             CASE WHEN {_ML_WINS} THEN {q(rules.ML_PATTERN_LABEL)} ELSE array_to_string(primary_patterns, ' ;; ') END AS matched,
             array_to_string(list_filter([CASE WHEN ni > 0 THEN 'prompt_injection' END, CASE WHEN nj > 0 THEN 'jailbreak' END,
                                          CASE WHEN ne > 0 THEN 'data_exfiltration' END, ml_prediction], lambda x: x IS NOT NULL), ',') AS all_threats
      FROM (SELECT *, threat_type AS rule_threat, confidence AS rule_confidence, passed AS rules_passed,
                   CAST((ni > 0)::INT + (nj > 0)::INT + (ne > 0)::INT AS BIGINT) AS rule_families,
                   CASE WHEN use_ml AND ml_malicious AND ml_confidence >= 0.8 THEN 'prompt_injection'
                        WHEN use_ml AND ml_malicious AND ml_confidence >= 0.6 THEN 'jailbreak' END AS ml_prediction
            FROM s))""", extra=[("s", inbound_cte("rule_prompts", "prompt"))])

ORACLE["blocked_prompts"] = with_views(["prompts"], f"""
SELECT request_id, client_id, threat_type, {SEVERITY_SQL} AS severity
FROM s WHERE NOT passed""", extra=[("s", inbound_cte("prompts", "prompt"))])

ORACLE["full_check"] = with_views(["pairs"], f"""
SELECT i.conv_id, i.turn, i.passed AS prompt_passed, i.threat_type AS prompt_threat,
       (CASE WHEN i.passed THEN 'low' WHEN i.confidence >= 0.8 THEN 'critical'
             WHEN i.confidence >= 0.6 THEN 'high' WHEN i.confidence >= 0.4 THEN 'medium' ELSE 'low' END) AS prompt_severity,
       o.passed AS response_passed, o.threat_type AS response_threat, o.severity AS response_severity,
       o.final_text AS response_final
FROM i JOIN o ON i.conv_id = o.conv_id AND i.turn = o.turn""",
    extra=[("i", inbound_cte("pairs", "prompt")), ("o", outbound_cte("pairs", "conv_id", "response"))])
