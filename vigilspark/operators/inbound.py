"""Inbound scan (C1-C8): rule matches, confidences, primary threat and verdict.

Each rule family yields the list of matching patterns in declaration order
(``array_compact`` over one ``rlike`` per pattern); a row is counted once per
pattern, not per occurrence.  An optional ML verdict (C7) joins the candidate
list as a fourth entry.  Everything is a native Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .partitioning import observe_scan


def rule_matches(text: Column, patterns: list[str]) -> Column:
    """Matched patterns (as their source text), declaration order."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(rules.java_regex(p, True)), F.lit(p)) for p in patterns]))


def rule_confidence(matched: Column, family: str) -> Column:
    base, step = rules.RULE_CONFIDENCE[family]
    n = F.size(matched).cast("double")
    return F.when(n > 0, F.least(n * F.lit(step) + F.lit(base), F.lit(1.0))).otherwise(F.lit(0.0))


def severity_of(conf: Column) -> Column:
    out = None
    for bound, name in rules.SEVERITY_BANDS:
        out = F.when(conf >= bound, name) if out is None else out.when(conf >= bound, name)
    return out.otherwise("low")


def threat_message(threat: Column) -> Column:
    """B16: 'prompt_injection' -> 'Prompt Injection detected'."""
    return F.concat(F.initcap(F.regexp_replace(threat, "_", " ")), F.lit(" detected"))


def ml_threat(ml_malicious: Column, ml_confidence: Column) -> Column:
    """Malicious and conf >= 0.6 -> threat; >= 0.8 injection else jailbreak."""
    hit = ml_malicious & (ml_confidence >= rules.ML_THREAT_MIN_CONFIDENCE)
    return F.when(hit, F.when(ml_confidence >= rules.ML_INJECTION_MIN_CONFIDENCE, "prompt_injection")
                  .otherwise("jailbreak"))


def inbound_scan(df: DataFrame, text_col: str = "prompt", use_ml: Column | bool = False,
                 ml_malicious_col: str | None = None, ml_confidence_col: str | None = None,
                 ml_available: bool = False, observation=None) -> DataFrame:
    """Adds rule matches and the verdict (C4-C7) to ``df``."""
    t = F.col(text_col)
    use_ml_c = use_ml if isinstance(use_ml, Column) else F.lit(bool(use_ml))
    staged = df.withColumn("injection_patterns", rule_matches(t, rules.INJECTION_PATTERNS)) \
        .withColumn("jailbreak_patterns", rule_matches(t, rules.JAILBREAK_PATTERNS)) \
        .withColumn("exfiltration_patterns", rule_matches(t, rules.EXFILTRATION_PATTERNS))
    fams = [("prompt_injection", "injection_patterns"), ("jailbreak", "jailbreak_patterns"),
            ("data_exfiltration", "exfiltration_patterns")]
    confs = {f: rule_confidence(F.col(c), f) for f, c in fams}
    staged = staged.withColumn("injection_confidence", confs["prompt_injection"]) \
        .withColumn("jailbreak_confidence", confs["jailbreak"]) \
        .withColumn("exfiltration_confidence", confs["data_exfiltration"])

    if ml_malicious_col and ml_confidence_col and ml_available:
        ml_t = F.when(use_ml_c, ml_threat(F.col(ml_malicious_col), F.col(ml_confidence_col)))
        ml_c = F.when(ml_t.isNotNull(), F.col(ml_confidence_col).cast("double"))
    else:
        ml_t = F.lit(None).cast("string")
        ml_c = F.lit(None).cast("double")
    staged = staged.withColumn("_ml_threat", ml_t).withColumn("_ml_conf", ml_c)

    # Candidates (found threats only) as (confidence, -order, type, patterns);
    # array_max picks the highest confidence and, on ties, the first in the
    # order injection, jailbreak, exfiltration, ml.  Every verdict column reads
    # this one struct, so when the optimizer substitutes aliases (predicate
    # pushdown) the expression grows linearly, not multiplicatively.
    def cand(found, order, ttype, conf, pats):
        return F.when(found, F.struct(conf.cast("double").alias("conf"), F.lit(-order).alias("neg_order"),
                                      ttype.alias("type"), pats.alias("patterns")))

    cands = F.array_compact(F.array(
        cand(F.size("injection_patterns") > 0, 0, F.lit("prompt_injection"), F.col("injection_confidence"),
             F.col("injection_patterns")),
        cand(F.size("jailbreak_patterns") > 0, 1, F.lit("jailbreak"), F.col("jailbreak_confidence"),
             F.col("jailbreak_patterns")),
        cand(F.size("exfiltration_patterns") > 0, 2, F.lit("data_exfiltration"), F.col("exfiltration_confidence"),
             F.col("exfiltration_patterns")),
        cand(F.col("_ml_threat").isNotNull(), 3, F.col("_ml_threat"), F.col("_ml_conf"),
             F.array(F.lit(rules.ML_PATTERN_LABEL)))))
    staged = staged.withColumn("_cands", cands).withColumn("_primary", F.array_max("_cands"))
    primary = F.col("_primary")
    any_threat = primary.isNotNull()

    out = staged.select(
        *[F.col(c) for c in df.columns],
        "injection_patterns", "jailbreak_patterns", "exfiltration_patterns",
        "injection_confidence", "jailbreak_confidence", "exfiltration_confidence",
        (~any_threat).alias("passed"),
        F.coalesce(primary["type"], F.lit("clean")).alias("threat_type"),
        F.when(any_threat, severity_of(primary["conf"])).otherwise(F.lit("low")).alias("severity"),
        F.coalesce(primary["conf"], F.lit(1.0)).alias("confidence"),
        F.coalesce(primary["patterns"], F.array().cast("array<string>")).alias("matched_patterns"),
        F.when(any_threat, threat_message(primary["type"])).otherwise(F.lit("No threats detected")).alias("message"),
        F.transform("_cands", lambda c: c["type"]).alias("all_threats"),
        F.col("_ml_threat").alias("ml_prediction"),
        F.col("_ml_conf").alias("ml_confidence"),
        F.when(any_threat, F.size(F.filter("_cands", lambda c: c["neg_order"] > -3))).cast("int")
         .alias("rule_detections"),
        use_ml_c.alias("ml_used"),
        F.lit(bool(ml_available)).alias("ml_available"),
    )
    return observe_scan(out, "inbound", observation=observation)


def blocked_prompts(scanned: DataFrame, block_on_injection: bool = True) -> DataFrame:
    """Rows whose verdict failed, when blocking is on."""
    return scanned.where(~F.col("passed") & F.lit(block_on_injection))
