"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all grades and
increasing thresholds t_0 < t_1 < ...; the expected severity is the sum of
P(grade > k).  Features are a document's distinct words and their prefixes of
``PREFIXES`` characters; x counts the distinct words with a feature.

``fit`` takes at most ``max_rows`` labelled rows (by a hash of the id, so the
same rows at any partitioning), and keeps at most ``FEATURES`` features,
those with the highest chi-square (``MIN_CHI`` at least); weights get an L1 penalty, so long clean texts collect no
drift.  Scoring covers every row and broadcasts the kept weights only.

Labels that only say toxic or not are graded by how much of it a toxic sample
text holds: 1 up to the median number of strongly toxic words, 2 above.

Defined cases: a null or empty text has no features; rows without an id or grade
do not train; of repeated labels of an id the highest grade counts; with fewer
than two grades in the sample every text gets the grades' shares; repeated rows
give a row each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, received, shipped, stage
from .words import split_words

MAX_ROWS = 8000
FEATURES = 4096
PREFIXES = (4, 5)
MIN_DOCS = 4
MIN_CHI = 10.83  # p < 0.001
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#-_/\\`~"


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def _distinct(part):
    """(text, word code) pairs, each once, and the trimmed words."""
    w = split_words(part.column("text"))
    trimmed = pc.ascii_trim(w.words.cast(pa.string()), PUNCTUATION).dictionary_encode()
    codes = trimmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.codes] if len(w.codes) else w.codes
    return w.owner, codes, trimmed.dictionary.to_pylist()


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def word_scores(self, words) -> np.ndarray:
        get = self.weights.get
        return np.array([sum(get(f, 0.0) for f in features(x)) if x else 0.0 for x in words] or [0.0])

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) by row and grade."""
        at_most = [1 / (1 + np.exp(np.clip(score - t, -500, 500))) for t in self.thresholds]
        edge = np.vstack([np.zeros_like(score), *at_most, np.ones_like(score)])
        return np.maximum(np.diff(edge, axis=0).T, 0)


def fit_ordinal(rows, grades: np.ndarray, n_features: int, n_grades: int, l1: float = 2e-4, rounds: int = 400):
    """Weights and thresholds by proximal gradient steps (accelerated) on the
    cumulative-link likelihood.  ``rows``: (row, feature, value) triples as arrays."""
    at, col, val = rows
    n = len(grades)
    K = n_grades - 1
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:K] / n, 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    w = np.zeros(n_features)
    norm = np.maximum(np.bincount(at, weights=val * val, minlength=n).max(initial=1), 1)
    step = 4.0 / (norm + K)
    zw, zt, k1 = w.copy(), t.copy(), 1.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    i = np.arange(n)
    for _ in range(rounds):
        s = np.bincount(at, weights=val * zw[col], minlength=n)
        up = np.ones((n, K + 2))
        up[:, 0] = 0
        up[:, 1:-1] = sig(zt[None, :] - s[:, None])
        slope = up * (1 - up)
        p = np.maximum(up[i, grades + 1] - up[i, grades], 1e-9)
        ds = (slope[i, grades + 1] - slope[i, grades]) / p  # of the loss by the score
        gt = np.zeros(K)
        for k in range(K):
            gt[k] = (slope[:, k + 1] / p * ((grades == k + 1).astype(float) - (grades == k))).sum() / n
        gw = np.bincount(col, weights=val * ds[at], minlength=n_features) / n
        new_w = zw - step * gw
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_t = np.maximum.accumulate(zt - step * gt + np.arange(K) * 1e-6)
        k2 = (1 + np.sqrt(1 + 4 * k1 * k1)) / 2
        zw, zt = new_w + (k1 - 1) / k2 * (new_w - w), np.sort(new_t + (k1 - 1) / k2 * (new_t - t))
        w, t, k1 = new_w, new_t, k2
    return w, t


def _sample_features(batches):
    for batch in batches:
        for part in by_bytes(batch, "text"):
            owner, codes, words = _distinct(part)
            per = [set() for _ in range(part.num_rows)]
            for pair in np.unique(owner * max(1, len(words)) + codes).tolist() if len(codes) else []:
                per[pair // len(words)].add(words[pair % len(words)])
            got = [[f for x in p if x for f in features(x)] for p in per]
            rows = [(i, f) for i, fs in enumerate(got) for f in fs]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("grade").take(at), pa.array([f for _, f in rows], pa.string())], ["doc_id", "grade", "feature"])


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", grade_col="toxic", binary: bool = True, max_rows: int = MAX_ROWS) -> Model:
    """Fits on a bounded sample; ``grade_col`` holds 0, 1, ... (``binary``: 0/1,
    graded further as the module says)."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(grade_col).cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_rows
    kind = src.schema["doc_id"].dataType.simpleString()
    f = src.select("doc_id", "text", "grade").mapInArrow(_sample_features, f"doc_id {kind}, grade int, feature string").groupBy("doc_id", "grade", "feature").agg(F.count("*").alias("n"))
    f = stage(f, "toxic-sample")
    totals = f.select("doc_id", "grade").distinct().agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    n, toxic = int(totals[0]), int(totals[1])
    if not toxic or toxic == n:
        return Model()
    a = F.col("a")
    both = f.groupBy("feature").agg(F.count("*").alias("df"), F.count_if(F.col("grade") > 0).alias("a")).where(F.col("df") >= MIN_DOCS)
    expected = F.col("df") * F.lit(toxic / n)
    picked = both.withColumn("chi", F.pow(a - expected, 2) / expected).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    index = {r["feature"]: k for k, r in enumerate(picked)}
    odds = np.array([np.log((r["a"] + 0.5) / (toxic + 1)) - np.log((r["df"] - r["a"] + 0.5) / (n - toxic + 1)) for r in picked])
    strong = {r["feature"] for r, o in zip(picked, odds) if o >= np.log(20) and not r["feature"].endswith("*")}
    spark = docs.sparkSession
    keep = F.broadcast(spark.createDataFrame([(k,) for k in index], "feature string"))  # at most FEATURES
    per_doc = f.join(keep, "feature").groupBy("doc_id", "grade").agg(F.collect_list(F.struct("feature", "n")).alias("fs")).collect()
    all_docs = f.select("doc_id", "grade").distinct().join(F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in per_doc], f"doc_id {kind}")), "doc_id", "left_anti").groupBy("grade").count().collect()
    at, col, val, grades, hits = [], [], [], [], []
    for i, r in enumerate(sorted(per_doc, key=lambda r: r["doc_id"])):
        grades.append(r["grade"])
        hits.append(sum(x["n"] for x in r["fs"] if x["feature"] in strong))
        for x in r["fs"]:
            at.append(i)
            col.append(index[x["feature"]])
            val.append(float(x["n"]))
    for r in all_docs:
        grades += [r["grade"]] * r["count"]
        hits += [0] * r["count"]
    grades, hits = np.array(grades), np.array(hits)
    if binary:
        grades = np.where(grades == 0, 0, 1 + (hits > np.median(hits[grades > 0])))
    n_grades = int(grades.max()) + 1
    w, t = fit_ordinal((np.array(at, int), np.array(col, int), np.array(val)), grades, len(index), n_grades)
    return Model({f: float(w[k]) for f, k in index.items() if w[k]}, t.tolist())


def _score(model):
    def run(batches):
        m = received(model)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                owner, codes, words = _distinct(part)
                s = m.word_scores(words)
                used = s[codes] != 0 if len(codes) else np.zeros(0, bool)
                pairs = np.unique(owner[used] * max(1, len(words)) + codes[used])
                total = np.bincount(pairs // max(1, len(words)), weights=s[pairs % max(1, len(words))], minlength=part.num_rows) if len(pairs) else np.zeros(part.num_rows)
                p = m.probabilities(total)
                grades = np.arange(p.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p @ grades), pa.array(p.argmax(axis=1), pa.int32()), pa.array(1 - p[:, 0] >= 0.5), pa.array(p.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "severity", "grade", "toxic", "probabilities"])
    return run


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row: doc_id, severity (expected grade), grade (likeliest),
    toxic (more likely
    above grade 0 than not), probabilities by grade."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = shipped(docs.sparkSession, model)
    return src.mapInArrow(_score(shared), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean, probabilities array<double>")
