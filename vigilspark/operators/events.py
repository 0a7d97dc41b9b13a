"""Security-event log: decode (A1), dashboard tables (A9), append (A7),
retention (H9).  Every clock is an ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_DATE = "event_date"


def decode_events(events: DataFrame) -> DataFrame:
    """A1: JSON columns decoded.  ``detected_patterns`` -> array<string>
    (malformed -> empty array, null stays null); ``metadata`` -> VARIANT
    (malformed -> empty object, null stays null)."""
    dp, md = F.col("detected_patterns"), F.col("metadata")
    patterns = F.when(dp.isNull(), F.lit(None).cast("array<string>")).otherwise(
        F.coalesce(F.from_json(dp, "array<string>"), F.array().cast("array<string>")))
    meta = F.when(md.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.try_parse_json(md), F.parse_json(F.lit("{}"))))
    return events.withColumn("detected_patterns", patterns).withColumn("metadata", meta)


def event_threat_type(event_type: Column, metadata: Column) -> Column:
    """Dashboard threat type of a log row."""
    return (F.when(event_type == "prompt_injection",
                   F.coalesce(F.get_json_object(metadata, "$.threat_type"), F.lit("prompt_injection")))
            .when(event_type == "data_leak", "pii_leak")
            .when(event_type == "rate_limit", "rate_limit")
            .when(event_type == "system_error", "system_error"))


def requests_from_events(events: DataFrame) -> DataFrame:
    """The dashboard's ``requests`` table derived from the log (closes Q12)."""
    return events.select(
        "id", "timestamp", "user_id",
        F.length("prompt").alias("prompt_length"),
        F.length("response").alias("response_length"),
        F.col("processing_time_ms").alias("latency_ms"),
        F.when(F.col("blocked"), "blocked").otherwise("success").alias("status"),
        event_threat_type(F.col("event_type"), F.col("metadata")).alias("threat_type"),
        "blocked",
        F.get_json_object("metadata", "$.model").alias("llm_provider"),
    )


def incidents_from_events(events: DataFrame, snippet_chars: int = 100) -> DataFrame:
    """The dashboard's ``incidents`` table = the blocked log rows."""
    return events.where(F.col("blocked")).select(
        "id", "timestamp", F.col("id").alias("request_id"),
        event_threat_type(F.col("event_type"), F.col("metadata")).alias("threat_type"),
        "severity",
        F.substring("prompt", 1, snippet_chars).alias("prompt_snippet"),
        F.substring("response", 1, snippet_chars).alias("response_snippet"),
        "action_taken",
        F.col("metadata").alias("details"),
    )


def materialize_log(events: DataFrame, path: str | None = None) -> DataFrame:
    """The boundary between assembling audit rows and querying them, as in a
    proxy that writes its log and dashboards that read it.  Either appends to
    a day-partitioned log at ``path`` and reads it back, or (no path) takes a
    reliable checkpoint into the shared checkpoint folder.

    Without it, dashboard filters over a freshly assembled log are pushed down
    through every projection, and the optimizer substitutes the whole scan
    logic into them repeatedly (the plan grows multiplicatively)."""
    if path:
        append_events(events, path)
        return read_events(events.sparkSession, path).drop(EVENT_DATE)
    from ..session import cut_lineage
    return cut_lineage(events)


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn(EVENT_DATE, F.to_date("timestamp"))


def append_events(events: DataFrame, path: str) -> None:
    """A7 (batch): append log rows, partitioned by day so time filters prune
    whole folders; rows within a file sorted by time for min/max pruning."""
    (with_event_date(events)
     .hint("rebalance", EVENT_DATE)  # adaptive execution splits a large day over several files
     .sortWithinPartitions("timestamp")
     .write.mode("append").partitionBy(EVENT_DATE).parquet(path))


def read_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retention_split(events: DataFrame, as_of: str, days_to_keep: int = 30):
    """H9: (kept rows, cutoff).  Rows with timestamp >= as_of - days, and rows
    without a timestamp, are kept."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days_to_keep))
    return events.where((F.col("timestamp") >= cutoff) | F.col("timestamp").isNull()), cutoff


def retention_report(events: DataFrame, as_of: str, days_to_keep: int = 30) -> DataFrame:
    """H9 report: kept and deleted counts in one pass."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days_to_keep))
    return events.agg(
        F.count_if((F.col("timestamp") >= cutoff) | F.col("timestamp").isNull()).alias("kept"),
        F.count_if(F.col("timestamp") < cutoff).alias("deleted"))


def apply_retention(events: DataFrame, as_of: str, days_to_keep: int, out_path: str) -> int:
    """H9 (rebuild): write the kept rows to a new location, return deleted count.
    Parquet has no DELETE; the caller swaps the table location afterwards."""
    kept, cutoff = retention_split(events, as_of, days_to_keep)
    append_events(kept, out_path)
    return events.where(F.col("timestamp") < cutoff).count()


def rewrite_retention(spark, path: str, as_of: str, days_to_keep: int = 30) -> int:
    """H9 in place on a log of ``append_events``: days that have wholly passed are dropped by their
    folders, the cutoff's own day is overwritten with its kept rows, and the files of
    later days and of rows without a timestamp stay as they are.  Returns the dropped days.
    A rewrite that stops halfway leaves rows that the next one drops."""
    from ..session import cut_lineage

    log = read_events(spark, path)
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days_to_keep))
    day = F.col(EVENT_DATE).cast("date")
    # one row per day folder: a listing, not the log
    days = log.select(day.alias("day")).where(F.col("day") <= F.to_date(cutoff)).distinct().withColumn("past", F.col("day") < F.to_date(cutoff)).collect()
    gone = [r["day"] for r in days if r["past"]]
    for r in days:
        if not r["past"]:
            kept = cut_lineage(log.where((day == F.lit(r["day"])) & (F.col("timestamp") >= cutoff)))
            if kept.isEmpty():
                gone.append(r["day"])
            else:
                (kept.sortWithinPartitions("timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy(EVENT_DATE).parquet(path))
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for d in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{EVENT_DATE}={d}")
        folder.getFileSystem(conf).delete(folder, True)
    return len(gone)
