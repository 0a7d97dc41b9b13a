"""Registered queries: validation and proxy outcome (B), policies (C9, H10,
H11), classifier and evaluation (E), entities (D3) and streaming (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import proxy as PX
from ..operators import validate as VL
from ..sources import fixtures as FX
from .registry import query


def _processed(spark, sf_dir):
    return PX.process_requests(FX.prompts(spark, sf_dir), FX.answers(spark, sf_dir))


@query("validate_requests")
def validate_requests(spark, sf_dir):
    """Error list, normalised fields and client fallback per request."""
    v = VL.validate_requests(FX.prompts(spark, sf_dir))
    return v.select("request_id", "client_id", "model", "max_tokens", "temperature", "valid",
                    F.array_join("errors", "; ").alias("errors"),
                    F.length("prompt").cast("long").alias("prompt_chars"))


@query("token_usage")
def token_usage(spark, sf_dir):
    """Whitespace word counts of the prompt and the final response."""
    r = PX.proxy_results(_processed(spark, sf_dir))
    return r.select("id", F.col("usage.prompt_tokens").alias("prompt_tokens"),
                    F.col("usage.completion_tokens").alias("completion_tokens"),
                    F.col("security.response_check.redacted").alias("redacted"))


@query("event_assembly")
def event_assembly(spark, sf_dir):
    """One audit row per valid request."""
    e = PX.to_events(_processed(spark, sf_dir))
    return e.select("id", "timestamp", "event_type", "severity", "user_id", "session_id", "prompt",
                    "response", "action_taken", "blocked",
                    F.col("detected_patterns").isNotNull().alias("has_patterns"))


@query("block_reasons")
def block_reasons(spark, sf_dir):
    """The block response of each blocked request."""
    return PX.block_reasons(_processed(spark, sf_dir))


@query("audit_metadata")
def audit_metadata(spark, sf_dir):
    """The patterns and the metadata of each audit row, parsed back from their JSON."""
    e = PX.to_events(_processed(spark, sf_dir))
    m = F.from_json("metadata", "model string, pii_detected boolean, ml_used boolean, confidence double, threat_type string, "
                                "details struct<message string, all_threats array<string>, rule_detections long, ml_used boolean>")
    return e.withColumn("m", m).select(
        "id", F.array_join(F.from_json("detected_patterns", "array<string>"), " ;; ").alias("patterns"),
        *[F.col(f"m.{c}").alias(c) for c in ("model", "pii_detected", "ml_used", "confidence", "threat_type")],
        F.col("m.details.message").alias("message"), F.array_join("m.details.all_threats", ",").alias("all_threats"),
        F.col("m.details.rule_detections").alias("rule_detections"), F.col("m.details.ml_used").alias("details_ml_used"))


@query("proxy_responses")
def proxy_responses(spark, sf_dir):
    """Every field of the body of each served request."""
    r = PX.proxy_results(_processed(spark, sf_dir))
    return r.select("id", "model", "response", "usage.prompt_tokens", "usage.completion_tokens",
                    F.col("security.prompt_check.passed").alias("prompt_passed"), F.col("security.prompt_check.ml_used").alias("ml_used"),
                    F.col("security.response_check.passed").alias("response_passed"),
                    F.col("security.response_check.redacted").alias("redacted"))


@query("failure_rows")
def failure_rows(spark, sf_dir):
    """The requests that validation rejects, as failure rows of the log."""
    v = VL.validate_requests(FX.prompts(spark, sf_dir)).where(~F.col("valid"))
    e = PX.error_events(v.withColumn("error", F.array_join("errors", "; ")).withColumn("error_type", F.lit("ValidationError")))
    return e.select("id", "timestamp", "event_type", "severity", "user_id", "session_id", "prompt", "action_taken", "blocked",
                    F.get_json_object("metadata", "$.error").alias("error"), F.get_json_object("metadata", "$.error_type").alias("error_type"))


@query("word_counts")
def word_counts(spark, sf_dir):
    """B8 on whole conversation turns (every role)."""
    from ..sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", word_count(F.col("text")).alias("n_words"))


# ------------------------------------------------------------- policies

def _policies(spark):
    from ..operators import policies as PL
    return PL.seed_if_empty(spark, None, FX.AS_OF)


@query("policy_match")
def policy_match(spark, sf_dir):
    """Enabled policies' patterns (seeded defaults) matched as literal text,
    input policies against prompts, output policies against responses."""
    from ..operators import policies as PL
    pol = _policies(spark)
    a = PL.policy_matches(FX.prompts(spark, sf_dir).select("request_id", "prompt"), "request_id", "prompt",
                          pol, "input").withColumnRenamed("request_id", "row_id").withColumn("source", F.lit("prompts"))
    b = PL.policy_matches(FX.responses(spark, sf_dir).select("id", "text"), "id", "text", pol, "output") \
        .withColumnRenamed("id", "row_id").withColumn("source", F.lit("responses"))
    u = a.unionByName(b)
    return u.select("source", "row_id", "policy", "n_matched", F.array_join("matched", ",").alias("matched"))


@query("name_match")
def name_match(spark, sf_dir):
    """C9 with a policy as large as a table: every customer's name as a literal pattern in the order notes."""
    from ..operators import policies as PL
    from ..sources.tables import read_table
    names = read_table(spark, sf_dir, "customer").select(F.lit("customers").alias("name"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("pattern")) \
        .withColumn("pattern_lc", F.lower("pattern"))
    return PL.literal_matches(FX.order_notes(spark, sf_dir), "note_id", "text", names, max_broadcast_rows=0)


@query("policy_snapshot")
def policy_snapshot(spark, sf_dir):
    """Latest policy state from the change log derived from events."""
    from ..operators import policies as PL
    return PL.policy_snapshot(FX.policy_changes(spark, sf_dir))


@query("policies_scan")
def policies_scan(spark, sf_dir):
    """A4: the snapshot's configs decoded (typed) with validity."""
    from ..operators import policies as PL
    d = PL.decode_policies(PL.policy_snapshot(FX.policy_changes(spark, sf_dir)), display=False)
    return d.select("name", "type", "enabled", "config_valid",
                    F.col("config_parsed.threshold").alias("threshold"))


@query("policy_texts")
def policy_texts(spark, sf_dir):
    """A4: the text shown for every config of the change log: indented, or as it is where it is no JSON."""
    from ..operators import policies as PL
    d = PL.decode_policies(FX.policy_changes(spark, sf_dir))
    return d.select("change_id", "config_valid", "config_display")


# ------------------------------------------------------------- entities (D3)

def _notes_with_entities(spark, sf_dir):
    from ..operators import entities as EN
    notes = FX.order_notes(spark, sf_dir)
    return EN.gazetteer_spans(notes, "note_id", "text", EN.entity_dictionary(spark, sf_dir))


@query("gazetteer_spans")
def gazetteer_spans(spark, sf_dir):
    n = _notes_with_entities(spark, sf_dir)
    from ..operators.partitioning import explode_computed
    return n.select("note_id", explode_computed("entity_spans", "s")).where(F.col("s").isNotNull()).select(
        "note_id", F.col("s.type").alias("type"), F.col("s.start").cast("long").alias("start"),
        F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("match"))


@query("date_time_spans")
def date_time_spans(spark, sf_dir):
    """D3: DATE and TIME spans of the dated order notes."""
    from ..operators import entities as EN
    from ..operators.partitioning import explode_computed
    n = EN.add_date_time_spans(FX.dated_notes(spark, sf_dir), "text")
    return n.select("note_id", explode_computed("date_time_spans", "s")).where(F.col("s").isNotNull()).select(
        "note_id", F.col("s.type").alias("type"), F.col("s.start").cast("long").alias("start"),
        F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("match"))


@query("supply_entities")
def supply_entities(spark, sf_dir):
    """D3: ORG by the gazetteer, DATE and TIME by the grammar, rows without an id kept."""
    from ..operators import entities as EN
    from ..operators.partitioning import explode_computed
    n = EN.gazetteer_spans(FX.supply_notes(spark, sf_dir), "note_id", "text", EN.entity_dictionary(spark, sf_dir))
    n = EN.add_date_time_spans(n, "text")
    return n.select("note_id", explode_computed(F.concat("entity_spans", "date_time_spans"), "s")).where(F.col("s").isNotNull()).select(
        "note_id", F.col("s.type").alias("type"), F.col("s.start").cast("long").alias("start"),
        F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("match"))


@query("redact_notes")
def redact_notes(spark, sf_dir):
    """D3 + D4/D6: entity findings first, then patterns; redacted text."""
    from ..operators import outbound as OB
    n = _notes_with_entities(spark, sf_dir)
    s = OB.outbound_scan(n, "text", entity_spans=F.col("entity_spans"))
    return s.select("note_id", "threat_type", "severity", "pii_count",
                    F.array_join("matched_patterns", ",").alias("matched_types"), "final_text")


# ------------------------------------------------------------- evaluation

@query("latency_stats")
def latency_stats(spark, sf_dir):
    from ..operators import ml as ML
    return ML.latency_stats(FX.inference_log(spark, sf_dir), "ts", "inference_time_ms", "event_id")


@query("roc_curve")
def roc_curve(spark, sf_dir):
    from ..operators import ml as ML
    p = ML.roc_points(FX.scored(spark, sf_dir), "label", "score", name_col="label_name")
    return p.select("label_name", "score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("roc_auc")
def roc_auc(spark, sf_dir):
    from ..operators import ml as ML
    a = ML.roc_auc(FX.scored(spark, sf_dir), "label", "score", name_col="label_name")
    return a.select("label_name", F.round("auc", 9).alias("auc"), "positives", "negatives")


@query("roc_store")
def roc_store(spark, sf_dir):
    """A5: both curves written as the stored JSON document and read back, with the areas beside them."""
    from ..operators import ml as ML
    from ..sources import jsonsrc, sinks
    sc = FX.scored(spark, sf_dir)
    path = sinks.write_roc_json(ML.roc_points(sc, "label", "score", name_col="label_name"),
                                ML.roc_auc(sc, "label", "score", name_col="label_name"))
    return jsonsrc.read_roc_json(spark, path).select(
        "label", F.col("i").cast("long").alias("i"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"),
        F.round("stored_auc", 9).alias("stored_auc"))


@query("stored_actions")
def stored_actions(spark, sf_dir):
    """The action map written and read as JSON, looked up for every labelled document."""
    from ..operators import ml as ML
    from ..sources import jsonsrc, sinks
    from ..sources.tables import read_table
    actions = jsonsrc.read_action_map(spark, sinks.write_action_map(ML.action_map_frame(spark)))
    label = F.when(F.col("toxic") == 1, "prompt_injection").when(F.col("quality") == 0, "sensitive_data").otherwise("benign")
    return ML.label_actions(read_table(spark, sf_dir, "labels").select("doc_id", label.alias("label")), actions)


def _predicted_labels(spark, sf_dir):
    from ..operators import inbound as IB
    from ..operators import outbound as OB
    p = IB.inbound_scan(FX.prompts(spark, sf_dir), "prompt").where(~F.col("passed")).select(
        F.lit("prompts").alias("source"), F.col("request_id").alias("row_id"),
        F.lit("prompt_injection").alias("label"))
    r = OB.outbound_scan(FX.responses(spark, sf_dir), "text") \
        .where(F.col("threat_type").isin("api_key_leak", "pii_leak")).select(
        F.lit("responses").alias("source"), F.col("id").alias("row_id"), F.lit("sensitive_data").alias("label"))
    return p.unionByName(r)


@query("label_actions")
def label_actions(spark, sf_dir):
    """Predicted label per row -> action (block / redact)."""
    from ..operators import ml as ML
    return ML.label_actions(_predicted_labels(spark, sf_dir), ML.action_map_frame(spark))


# ------------------------------------------------------------- classifier (E1-E3, C7): rows-only checks

def _training(spark, sf_dir):
    from ..sources.tables import read_table
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lab.join(doc, "doc_id").select(
        "text", F.when(F.col("toxic") == 1, "prompt_injection").otherwise("benign").alias("label"))


@query("score_prompts")
def score_prompts(spark, sf_dir):
    """Train TF-IDF + logistic regression on labelled documents, score
    every prompt."""
    from ..operators import ml as ML
    model = ML.train_classifier(_training(spark, sf_dir), max_iter=20)
    s = ML.score(model, FX.prompts(spark, sf_dir), "prompt")
    return s.select("request_id", "ml_label", "ml_confidence", "ml_malicious")


@query("inbound_scan_ml")
def inbound_scan_ml(spark, sf_dir):
    """Rules plus the classifier verdict as a fourth candidate."""
    from ..operators import inbound as IB
    from ..operators import ml as ML
    model = ML.train_classifier(_training(spark, sf_dir), max_iter=20)
    s = ML.score(model, FX.prompts(spark, sf_dir), "prompt")
    out = IB.inbound_scan(s, "prompt", use_ml=F.coalesce(F.col("use_ml"), F.lit(True)),
                          ml_malicious_col="ml_malicious", ml_confidence_col="ml_confidence", ml_available=True)
    return out.select("request_id", "passed", "threat_type", "severity", "confidence", "ml_prediction",
                      "rule_detections")


# ------------------------------------------------------------- sinks

@query("audit_append")
def audit_append(spark, sf_dir):
    """The assembled audit rows appended to a day-partitioned log, read back."""
    from ..operators.events import EVENT_DATE
    from ..sources.sinks import audit_append as append
    path = append(PX.to_events(_processed(spark, sf_dir)))
    e = spark.read.parquet(path).drop(EVENT_DATE)
    return e.select("id", "timestamp", "event_type", "severity", "user_id", "session_id", "prompt",
                    "response", "action_taken", "blocked",
                    F.col("detected_patterns").isNotNull().alias("has_patterns"))


@query("incidents_export")
def incidents_export(spark, sf_dir):
    """The filtered incident list exported as CSV with a header, read back
    with its schema."""
    from ..sources.sinks import export_csv, read_csv_export
    from .registry_events import _incident_list
    lst = _incident_list(spark, sf_dir)
    return read_csv_export(spark, export_csv(lst), lst.schema)
