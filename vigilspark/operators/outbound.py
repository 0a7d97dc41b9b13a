"""Outbound scan (D1-D11): findings, verdict, details and redaction over a text column.

All work is native Catalyst expressions; the findings array is computed once per
row and reused (Spark's CollapseProject does not inline expensive expressions
that are referenced more than once), so each pattern is scanned once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, spans as S
from .partitioning import explode_computed, observe_scan, posexplode_computed


def outbound_scan(df: DataFrame, text_col: str = "text", redact: bool = True,
                  max_tokens: int = rules.MAX_RESPONSE_TOKENS,
                  entity_spans: Column | None = None,
                  merge_overlaps: bool = False, observation=None) -> DataFrame:
    """Adds the outbound verdict columns to ``df``.

    ``entity_spans``: optional array<span> column expression with named-entity
    findings (D3); they come first in the findings, like the reference.
    """
    t = F.col(text_col)
    staged = df.withColumn("_ner", entity_spans if entity_spans is not None else S.empty_spans())
    staged = S.add_pii_spans(staged, text_col, "_pii")
    staged = S.add_secret_spans(staged, text_col, "_sec")
    findings = F.concat(F.col("_ner"), F.col("_pii"), F.col("_sec"))
    staged = staged.withColumn("findings", findings)

    n_all = F.size("findings")
    pii_count = F.size("_ner") + F.size("_pii")
    sec_count = F.size("_sec")
    excessive = F.coalesce((F.length(t) / F.lit(rules.CHARS_PER_TOKEN)) > F.lit(max_tokens), F.lit(False))  # no text: clean

    threat = (F.when(sec_count > 0, "api_key_leak").when(pii_count > 0, "pii_leak")
              .when(excessive, "excessive_output").otherwise("clean"))
    severity = (F.when(sec_count > 0, "critical")
                .when(pii_count > 0, F.when(n_all > 3, "high").otherwise("medium"))
                .when(excessive, "medium").otherwise("low"))
    confidence = (F.when(sec_count > 0, 0.95).when(pii_count > 0, 0.85)
                  .when(excessive, 0.7).otherwise(1.0)).cast("double")
    clean = (sec_count == 0) & (pii_count == 0) & ~excessive

    if merge_overlaps:
        staged = S.add_merged_spans(staged, "findings", "_merged")
    # the sorted spans and the text chunks are staged once per row
    need = F.lit(redact) & (n_all > 0)
    staged = staged.withColumn("_ord", F.when(need, S.sorted_for_redaction(F.col("_merged" if merge_overlaps else "findings")))) \
        .withColumn("_chunks", F.when(need & (F.length(t) > S.SHORT_TEXT), S.text_chunks(t)))
    redacted = S.redact_sorted(t, F.col("_ord"), F.col("_chunks"))
    sanitized = (F.when(clean, t)
                 .when(F.lit(redact) & (n_all > 0), redacted)
                 .otherwise(F.lit(None).cast("string")))
    details_findings = F.transform(F.slice(F.col("findings"), 1, 10), lambda s: F.struct(
        S.preview(s["text"]).alias("text"), s["type"].alias("type"),
        F.array(s["start"], s["end"]).alias("position")))
    message = F.when(clean, F.lit("No sensitive data detected")).otherwise(
        F.concat(F.lit("Detected "), n_all.cast("string"), F.lit(" sensitive items")))

    out = staged.select(
        *[F.col(c) for c in df.columns],
        F.col("findings"),
        pii_count.cast("long").alias("pii_count"),
        sec_count.cast("long").alias("secrets_count"),
        excessive.alias("excessive_length"),
        clean.alias("passed"),
        threat.alias("threat_type"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        message.alias("message"),
        F.when(clean, F.array().cast("array<string>"))
         .otherwise(F.transform(F.col("findings"), lambda s: s["type"])).alias("matched_patterns"),
        F.when(clean, F.lit(None)).otherwise(details_findings).alias("details_findings"),
        sanitized.alias("sanitized_text"),
    )
    # The final text is the sanitized text when present (''/null fall back).
    final = F.when(F.col("sanitized_text").isNull() | (F.col("sanitized_text") == ""), t) \
        .otherwise(F.col("sanitized_text"))
    return observe_scan(out.withColumn("final_text", final), "outbound", observation=observation)


def findings_long(df: DataFrame, id_col: str, spans_col: str) -> DataFrame:
    """One row per finding with its ordinal (for exports and profiles)."""
    return df.select(F.col(id_col), posexplode_computed(spans_col, "ordinal", "f")).where(F.col("f").isNotNull()).select(
        id_col, "ordinal", F.col("f.type").alias("type"), F.col("f.start").alias("start"),
        F.col("f.end").alias("end"), F.col("f.text").alias("text"))


def findings_profile(scans: DataFrame, source: str) -> DataFrame:
    """Count of findings per type (partial aggregation before the shuffle)."""
    return (scans.select(explode_computed("findings", "f")).where(F.col("f").isNotNull())
            .groupBy(F.col("f.type").alias("type")).agg(F.count(F.lit(1)).alias("n_findings"))
            .withColumn("source", F.lit(source)))
