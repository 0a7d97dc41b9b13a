"""Batch sinks: audit-log append (A7), CSV export of incidents (A8), and the JSON
documents that ``jsonsrc`` reads (A5, A6).

Paths live under the shared checkpoint folder unless the caller gives one;
writes are whole-job commits (Spark's file committer), so a lost executor
only re-runs its tasks and never leaves partial output behind.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import append_events
from ..session import scratch_path


# Microsecond timestamps so an export reads back exactly.
CSV_OPTIONS = {"header": "true", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def export_csv(df: DataFrame, out_dir: str | None = None, prefix: str = "incidents",
               now: dt.datetime | None = None) -> str:
    """Header, no index, one folder named ``<prefix>_<YYYYmmdd_HHMMSS>``."""
    base = out_dir or scratch_path(df.sparkSession, "export")
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = os.path.join(base, f"{prefix}_{stamp}")
    df.write.mode("error").options(**CSV_OPTIONS).csv(path)
    return path


def read_csv_export(spark, path: str, schema) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def audit_append(events: DataFrame, path: str | None = None) -> str:
    """A7 (batch): append audit rows to a day-partitioned parquet log."""
    path = path or scratch_path(events.sparkSession, "audit")
    append_events(events, path)
    return path


def write_roc_json(points: DataFrame, auc: DataFrame, path: str | None = None, steps: int = 200) -> str:
    """A5, the writing side: the curves of ``ml.roc_points`` and the areas of
    ``ml.roc_auc`` as one JSON document of three maps by label.

    A curve has as many points as there are distinct scores, so it is stored at
    ``steps`` thresholds of [0, 1]: of the scores between two thresholds (those
    outside go to the nearest) the lowest one's point, which is a point of the
    full curve.  So the document has at most ``steps`` + 2 points a label,
    whatever the number of scores.  Labels without a name are left out."""
    path = path or scratch_path(points.sparkSession, "roc")
    step = F.when(F.col("score").isNotNull(), F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * steps))
    at = points.where(F.col("label_name").isNotNull()).groupBy("label_name", step.alias("step")).agg(F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr"))
    curves = at.groupBy("label_name").agg(F.array_sort(F.collect_list(F.struct("fpr", "tpr"))).alias("pts"))
    entry = lambda value: F.map_from_entries(F.collect_list(F.struct("label_name", value.alias("value"))))
    whole = curves.join(auc.select("label_name", "auc"), "label_name", "left").agg(
        entry(F.col("pts.fpr")).alias("fpr"), entry(F.col("pts.tpr")).alias("tpr"), entry(F.col("auc")).alias("auc"))
    whole.write.json(path)
    return path


def write_action_map(actions: DataFrame, path: str | None = None) -> str:
    """A6, the writing side: rows (map_label, action), each label once, as one JSON object."""
    path = path or scratch_path(actions.sparkSession, "actions")
    pairs = F.collect_list(F.struct("map_label", "action"))
    actions.where(F.col("map_label").isNotNull()).agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path
