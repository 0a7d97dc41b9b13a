"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads whole driver tables (through the views in
``vigilspark.sources.fixtures``) and projects the operator's result to plain
columns whose names match the DuckDB oracle in ``vigilspark.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inbound as IB
from ..operators import outbound as OB
from ..sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Import the modules that register further queries.
    from . import registry_events, registry_more, registry_stream  # noqa: F401
    return dict(QUERIES)


# ---------------------------------------------------------------- outbound (D)

def _scanned_responses(spark, sf_dir, **kw):
    return OB.outbound_scan(FX.responses(spark, sf_dir), "text", **kw)


def _joined_types(col="matched_patterns"):
    return F.array_join(F.col(col), ",")


@query("redact_documents")
def redact_documents(spark, sf_dir):
    """Flagship: scan, classify and redact every response."""
    s = _scanned_responses(spark, sf_dir)
    return s.select(
        F.col("id").alias("doc_id"), "threat_type", "severity", "confidence",
        "pii_count", "secrets_count", F.size("findings").cast("long").alias("n_findings"),
        "excessive_length", "passed", "final_text")


@query("redact_merged")
def redact_merged(spark, sf_dir):
    """D5 on the same table (no overlaps there, so equal to the faithful fold)."""
    s = _scanned_responses(spark, sf_dir, merge_overlaps=True)
    return s.select(F.col("id").alias("doc_id"), "final_text")


@query("redact_overlaps")
def redact_overlaps(spark, sf_dir):
    """Merged redaction of texts whose findings nest, chain or start together."""
    s = OB.outbound_scan(FX.tangled_responses(spark, sf_dir), "text", merge_overlaps=True)
    return s.select(F.col("id").alias("doc_id"), F.size("findings").cast("long").alias("n_findings"), "final_text")


@query("outbound_scan")
def outbound_scan_q(spark, sf_dir):
    """Verdict, message, finding types and the first-10 previews."""
    s = _scanned_responses(spark, sf_dir)
    return s.select(
        F.col("id").alias("doc_id"), "threat_type", "severity", "confidence", "message",
        _joined_types().alias("matched_types"),
        F.array_join(F.transform(F.coalesce("details_findings", F.array()), lambda f: f["text"]), " | ")
         .alias("finding_previews"),
        F.col("sanitized_text").isNotNull().alias("redacted"))


def _spans_long(spark, sf_dir, which):
    from ..functions import spans as S
    r = FX.responses(spark, sf_dir).select("id", "text")
    r = S.add_pii_spans(r, "text", "spans") if which == "pii" else S.add_secret_spans(r, "text", "spans")
    from ..operators.partitioning import explode_computed
    return r.select("id", explode_computed("spans", "s")).where(F.col("s").isNotNull()).select(
        F.col("id").alias("doc_id"), F.col("s.type").alias("type"),
        F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"),
        F.col("s.text").alias("match"))


@query("pii_spans")
def pii_spans_q(spark, sf_dir):
    return _spans_long(spark, sf_dir, "pii")


@query("secret_spans")
def secret_spans_q(spark, sf_dir):
    return _spans_long(spark, sf_dir, "secret")


@query("findings_profile")
def findings_profile_q(spark, sf_dir):
    """Findings per type over responses and over raw pages."""
    from ..sources.tables import read_table
    a = OB.findings_profile(_scanned_responses(spark, sf_dir), "responses")
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    b = OB.findings_profile(OB.outbound_scan(pages, "text"), "pages")
    return a.unionByName(b).select("source", "type", "n_findings")


@query("excess_output")
def excess_output_q(spark, sf_dir):
    """Token estimate = chars / 4, flagged when strictly above the limit."""
    from ..functions.text import estimated_tokens, is_excessive
    r = FX.responses(spark, sf_dir)
    return r.select(F.col("id").alias("doc_id"), estimated_tokens(F.col("text")).alias("estimated_tokens"),
                    is_excessive(F.col("text")).alias("excessive"))


# ----------------------------------------------------------------- inbound (C)

def _scanned_prompts(spark, sf_dir):
    return IB.inbound_scan(FX.prompts(spark, sf_dir), "prompt")


def _family_query(family_col, conf_col):
    def fn(spark, sf_dir):
        s = _scanned_prompts(spark, sf_dir)
        return s.select("request_id", F.array_join(family_col, " ;; ").alias("matched"),
                        F.size(family_col).cast("long").alias("n_matched"),
                        F.col(conf_col).alias("confidence"))
    return fn


QUERIES["inbound_injection"] = _family_query("injection_patterns", "injection_confidence")
QUERIES["inbound_jailbreak"] = _family_query("jailbreak_patterns", "jailbreak_confidence")
QUERIES["inbound_exfiltration"] = _family_query("exfiltration_patterns", "exfiltration_confidence")


@query("inbound_scan")
def inbound_scan_q(spark, sf_dir):
    """Primary threat, severity, confidence, message, all threats."""
    s = _scanned_prompts(spark, sf_dir)
    return s.select("request_id", "passed", "threat_type", "severity", "confidence", "message",
                    F.array_join("matched_patterns", " ;; ").alias("matched"),
                    F.array_join("all_threats", ",").alias("all_threats"),
                    F.col("rule_detections").cast("long").alias("rule_detections"))


@query("inbound_rules")
def inbound_rules(spark, sf_dir):
    """One row per prompt and rule that matches it; the view reaches all 30 rules."""
    s = IB.inbound_scan(FX.rule_prompts(spark, sf_dir), "prompt")

    def rows(family, col):
        return F.transform(col, lambda p: F.struct(F.lit(family).alias("threat"), p.alias("rule")))

    found = F.concat(rows("prompt_injection", "injection_patterns"), rows("jailbreak", "jailbreak_patterns"),
                     rows("data_exfiltration", "exfiltration_patterns"))
    from ..operators.partitioning import explode_computed
    return s.select("request_id", explode_computed(found, "m")).where(F.col("m").isNotNull()).select("request_id", "m.threat", "m.rule")


@query("ml_verdicts")
def ml_verdicts(spark, sf_dir):
    """The classifier's verdict (a fixed score column) as fourth candidate beside the rules."""
    s = IB.inbound_scan(FX.rule_prompts(spark, sf_dir), "prompt", use_ml=F.col("use_ml"), ml_malicious_col="ml_malicious",
                        ml_confidence_col="ml_confidence", ml_available=True)
    return s.select("request_id", "passed", "threat_type", "severity", "confidence", F.array_join("matched_patterns", " ;; ").alias("matched"),
                    F.array_join("all_threats", ",").alias("all_threats"), "ml_prediction", F.col("rule_detections").cast("long").alias("rule_detections"))


@query("blocked_prompts")
def blocked_prompts_q(spark, sf_dir):
    """Prompts that would be blocked (failed verdict, blocking on)."""
    s = IB.blocked_prompts(_scanned_prompts(spark, sf_dir))
    return s.select("request_id", "client_id", "threat_type", "severity")


@query("full_check")
def full_check_q(spark, sf_dir):
    """Inbound on the user turn, outbound on the paired assistant turn."""
    p = FX.pairs(spark, sf_dir)
    s = IB.inbound_scan(p, "prompt").select(
        "conv_id", "turn", "response",
        F.col("passed").alias("prompt_passed"), F.col("threat_type").alias("prompt_threat"),
        F.col("severity").alias("prompt_severity"))
    o = OB.outbound_scan(s, "response")
    return o.select("conv_id", "turn", "prompt_passed", "prompt_threat", "prompt_severity",
                    F.col("passed").alias("response_passed"), F.col("threat_type").alias("response_threat"),
                    F.col("severity").alias("response_severity"), F.col("final_text").alias("response_final"))
