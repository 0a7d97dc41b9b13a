"""Classifier and evaluation.

E1-E3: a ``pyspark.ml`` pipeline (tokenise, hashed TF, IDF, logistic
regression) trained and applied as distributed jobs; no model file.
E4: latency statistics over the newest inferences.
E5/E6: ROC curves and AUC of several labels in one pass; cumulative counts along
the score order are running sums over range partitions (``running.running_sums``).
E7: label -> action lookup, an equi-join whose strategy the optimizer picks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..session import scratch_path
from .running import running_sums

MALICIOUS_LABEL = "prompt_injection"
BENIGN_LABEL = "benign"


# ------------------------------------------------------------------ E1-E3

@dataclass
class TextClassifier:
    """A fitted text pipeline, its class labels (index order) and the prefix of its own columns."""
    pipeline: PipelineModel
    labels: list
    prefix: str


def train_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                     num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01) -> TextClassifier | None:
    """TF-IDF + logistic regression on a (text, string label) frame.
    Hashed term frequencies keep the vocabulary off the driver.

    Null texts count as empty, rows without a label are left out.  None when no
    row has a label: ``score`` then answers as without a model.  With one label
    every text gets it."""
    prefix = f"_ml_{uuid.uuid4().hex[:12]}_"
    own = {c: prefix + c for c in ("text", "y", "tokens", "tf", "features", "prob", "pred", "raw")}
    df = df.select(F.coalesce(F.col(text_col), F.lit("")).alias(own["text"]), F.col(label_col).alias("label")).where("label is not null")
    labels = list(StringIndexer(inputCol="label", outputCol=own["y"]).fit(df).labels)
    if not labels:
        return None
    indexer = StringIndexerModel.from_labels(labels, inputCol="label", outputCol=own["y"])
    tok = RegexTokenizer(inputCol=own["text"], outputCol=own["tokens"], pattern=r"(?U)\W+", toLowercase=True)
    tf = HashingTF(inputCol=own["tokens"], outputCol=own["tf"], numFeatures=num_features)
    idf = IDF(inputCol=own["tf"], outputCol=own["features"])
    lr = LogisticRegression(featuresCol=own["features"], labelCol=own["y"], maxIter=max_iter, regParam=reg,
                            probabilityCol=own["prob"], predictionCol=own["pred"], rawPredictionCol=own["raw"])
    pipe = Pipeline(stages=[tok, tf, idf, lr]).fit(indexer.transform(df))
    # A fitted model keeps its training summary and with it the session, which cannot be sent to
    # tasks once an Observation was used in it; the model read back from the shared folder has none.
    path = scratch_path(df.sparkSession, "classifier")
    pipe.stages[-1].write().save(path)
    return TextClassifier(PipelineModel([*pipe.stages[:-1], LogisticRegressionModel.load(path)]), labels, prefix)


def score(model: TextClassifier | None, df: DataFrame, text_col: str = "text",
          confidence_threshold: float = rules.ML_MALICIOUS_MIN_CONFIDENCE) -> DataFrame:
    """Predicted label, class probabilities, confidence = max
    probability, malicious = label is prompt_injection and confidence >=
    threshold.  Without a model every row gets (False, 0.0, error).  A null text
    is scored as an empty one; the frame's own columns stay as they are."""
    if model is None:
        return df.withColumn("ml_label", F.lit(None).cast("string")) \
            .withColumn("ml_probabilities", F.lit(None).cast("map<string,double>")) \
            .withColumn("ml_confidence", F.lit(0.0)) \
            .withColumn("ml_malicious", F.lit(False)) \
            .withColumn("ml_threshold", F.lit(rules.ML_THRESHOLD_REPORTED)) \
            .withColumn("ml_error", F.lit("Classifier not available"))
    labels, own = model.labels, model.prefix
    conv = IndexToString(inputCol=own + "pred", outputCol="ml_label", labels=labels)
    out = conv.transform(model.pipeline.transform(df.withColumn(own + "text", F.coalesce(F.col(text_col), F.lit(""))).drop("ml_label")))
    # one label: the model still holds two classes
    out = out.withColumn(own + "p", F.slice(vector_to_array(F.col(own + "prob")), 1, len(labels)))
    out = out.withColumn("ml_probabilities", F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.col(own + "p"))) \
        .withColumn("ml_confidence", F.array_max(own + "p")) \
        .withColumn("ml_malicious", (F.col("ml_label") == MALICIOUS_LABEL) &
                    (F.col("ml_confidence") >= confidence_threshold)) \
        .withColumn("ml_threshold", F.lit(rules.ML_THRESHOLD_REPORTED)) \
        .withColumn("ml_error", F.lit(None).cast("string"))
    return out.drop(*[c for c in out.columns if c.startswith(own)])


# ------------------------------------------------------------------ E4

def latency_stats(log: DataFrame, ts_col: str = "ts", value_col: str = "inference_time_ms",
                  id_col: str | None = None, window: int = 100) -> DataFrame:
    """Over the newest ``window`` inferences (a top-k, then one tiny agg)."""
    order = [F.col(ts_col).desc()] + ([F.col(id_col).desc()] if id_col else [])
    recent = log.orderBy(*order).limit(window)
    x = F.col(value_col)
    return recent.agg(
        F.count(x).alias("count"),
        F.round(F.avg(x), 2).alias("mean_ms"),
        F.round(F.median(x), 2).alias("median_ms"),
        F.round(F.percentile(x, F.lit(0.95)), 2).alias("p95_ms"),
        F.round(F.min(x), 2).alias("min_ms"),
        F.round(F.max(x), 2).alias("max_ms"))


# ------------------------------------------------------------------ E5/E6

def _cumulative(scored: DataFrame, label_col: str, score_col: str, name: Column) -> DataFrame:
    """One row per label name and distinct score: pos, neg, and tp, fp = positives and negatives
    with this score or more.  All label names in one pass."""
    counts = scored.where(F.col(score_col).isNotNull()).groupBy(name.alias("label_name"), F.col(score_col).alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) != 1).alias("neg"))
    return running_sums(counts, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, ["label_name"])


def _name(label_name: str | None, name_col: str | None) -> Column:
    return F.col(name_col) if name_col else F.lit(label_name or "label")


def roc_points(scored: DataFrame, label_col: str = "label", score_col: str = "score",
               label_name: str | None = None, name_col: str | None = None) -> DataFrame:
    """E5: one ROC point per distinct score (ties grouped first, so the curve
    does not depend on row order), plus the (0, 0) origin; one curve for each value of
    ``name_col`` (one-vs-rest).  Rows without a score are left out.  Columns: label_name,
    score (NULL at the origin), fpr, tpr."""
    cum = _cumulative(scored, label_col, score_col, _name(label_name, name_col))
    tot = cum.groupBy("label_name").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.join(tot, "label_name").select("label_name", "score", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    origin = tot.select("label_name", F.lit(None).cast("double").alias("score"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def roc_auc(scored: DataFrame, label_col: str = "label", score_col: str = "score",
            label_name: str | None = None, name_col: str | None = None) -> DataFrame:
    """Trapezoid area under each curve of ``roc_points``.  Between
    consecutive points the trapezoid is neg(s)/N * (tp_above(s) + pos(s)/2)/P,
    so the area is one sum over distinct scores (no neighbour lookup)."""
    cum = _cumulative(scored, label_col, score_col, _name(label_name, name_col))
    part = cum.groupBy("label_name").agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)).alias("_area"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select("label_name", F.try_divide("_area", F.col("P") * F.col("N")).alias("auc"),
                       F.col("P").alias("positives"), F.col("N").alias("negatives"))


def trapezoid_auc(points: DataFrame, label_col: str = "label", order_col: str = "i") -> DataFrame:
    """AUC of stored curve points (label, i, fpr, tpr) by the trapezoid rule;
    the window is per label over that label's points."""
    w = Window.partitionBy(label_col).orderBy(order_col)
    seg = points.withColumn("_pf", F.lag("fpr").over(w)).withColumn("_pt", F.lag("tpr").over(w))
    return seg.groupBy(label_col).agg(
        F.sum((F.col("fpr") - F.col("_pf")) * (F.col("tpr") + F.col("_pt")) / 2).alias("auc"))


# ------------------------------------------------------------------ E7

def label_actions(predictions: DataFrame, action_map: DataFrame, label_col: str = "label") -> DataFrame:
    """Action per predicted label (left join; unknown label -> NULL)."""
    return predictions.join(action_map, predictions[label_col] == action_map["map_label"], "left") \
        .drop("map_label")


def action_map_frame(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.LABEL_ACTIONS.items()), "map_label string, action string")
