"""JSON sources: stored ROC curves (A5) and the label -> action map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_roc_json(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``{"fpr": {label: [...]}, "tpr": {label: [...]}, "auc": {label: x}}``
    -> rows (label, i, fpr, tpr, stored_auc)."""
    raw = spark.read.option("multiLine", True) \
        .schema("fpr map<string,array<double>>, tpr map<string,array<double>>, auc map<string,double>") \
        .json(path)
    per_label = raw.select(F.explode("fpr").alias("label", "fpr_list"), "tpr", "auc") \
        .select("label", F.arrays_zip(F.col("fpr_list").alias("fpr"),
                                      F.element_at("tpr", F.col("label")).alias("tpr")).alias("pts"),
                F.element_at("auc", F.col("label")).alias("stored_auc"))
    return per_label.select("label", F.posexplode("pts").alias("i", "p"), "stored_auc") \
        .select("label", "i", F.col("p.fpr").alias("fpr"), F.col("p.tpr").alias("tpr"), "stored_auc")


def read_action_map(spark: SparkSession, path: str) -> DataFrame:
    """``{label: action}`` -> rows (map_label, action)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("map_label", "action"))
