"""Quality rules: cross-document line frequency.

Every line is normalised (A-Z lower-cased, white space collapsed) and hashed
(128 bits); for each (host, line) the distinct documents that hold it are
counted.  Lines above ``max_docs`` are removed from all documents of the host
but the first holder (smallest id), and a document that loses more than
``1 - min_kept`` of its words is rejected as depleted.  Documents count by their
text: exact copies are one document.  A hot line is spread over its documents'
keys before it is counted.

Base rules reject texts of under 50 words and texts with more than half their
words in repeated three-word windows.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; lines without a word are never counted or removed; repeated
rows give a row each and count once; rows without an id are no first holders;
other columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, carried, stage, text_key, unpacked
from .words import split_words

MAX_DOCS = 10
MIN_KEPT = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line: bytes) -> tuple[bytes, int]:
    """Hash of the normalised line and its words."""
    words = line.lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)), len(words)


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(codes) < 4:
        return 0
    pair = codes[:-1] * distinct + codes[1:]
    if distinct >= 1 << 20:  # three codes don't fit 63 bits: number the pairs
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * distinct + codes[2:]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(windows, again))
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _measure(batches):
    for batch in batches:
        for part in by_bytes(batch, "text"):
            texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            w = split_words(part.column("text"), lower=False)
            starts = w.offsets.tolist()
            measures, hashes, sizes = [], [], []
            for i, t in enumerate(texts):
                raw, seen, dup = set(), {}, 0
                for line in t.split(b"\n"):
                    h, n = line_hash(line)
                    if n:
                        dup += line in raw
                        raw.add(line)
                        seen[h] = seen.get(h, 0) + n
                white = sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
                measures.append((starts[i + 1] - starts[i], len(t.decode("utf-8", "replace")) - white,
                                 sum(t.count(SYMBOLS[k:k + 1]) for k in range(len(SYMBOLS))), dup,
                                 repeated_words(w.codes[starts[i]:starts[i + 1]], len(w.words))))
                hashes.append(list(seen))
                sizes.append(list(seen.values()))
            columns = list(zip(*measures))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), part.column("host"), *[pa.array(c, pa.int64()) for c in columns],
                 pa.array(hashes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))],
                ["doc_id", "key", "host", *METRICS, "lines", "line_words"])


def measure(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """Base measures and the line hashes (with their words) of every row, written once."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"),
                      F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    return stage(src.mapInArrow(_measure, f"doc_id {id_type}, key long, host string, " + "".join(f"{m} long, " for m in METRICS)
                                + "lines array<binary>, line_words array<int>"), "lines")


def removed_lines(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, key, host, line, words): the lines that each document loses."""
    lines = measured.select("doc_id", "key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "doc_id", "key", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    per_text = lines.groupBy("host", "line", "key").agg(F.min("doc_id").alias("first"))
    above = per_text.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") > max_docs)
    return lines.join(above, ["host", "line"]).where(F.col("doc_id").isNull() | F.col("first").isNull() | (F.col("doc_id") != F.col("first"))).select(
        "doc_id", "key", "host", "line", "words").distinct()


def verdicts(measured: DataFrame, removed: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    lost = removed.groupBy("doc_id", "key", "host").agg(
        F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines")).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("host").alias("_host"), "removed_words", "removed_lines")
    d = measured.drop("lines", "line_words")
    d = d.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("host") == F.col("_host")), "left")
    d = d.fillna(0, ["removed_words", "removed_lines"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("n_words") - F.col("removed_words") >= min_kept * F.col("n_words")
    return d.select("doc_id", "key", "host", *METRICS, failed.alias("base_failed"), (~failed & enough).alias("kept"), "removed_words", "removed_lines")


def judge(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept,
    removed_words, removed_lines."""
    m = measure(docs, id_col, text_col, host_col)
    return verdicts(m, removed_lines(m, max_docs), min_kept).drop("key", "host")


def _strip(batches):
    for batch in batches:
        for part in by_bytes(batch, "text"):
            texts, gone = part.column("text").cast(pa.binary()).to_pylist(), part.column("gone").to_pylist()
            for i, lines in enumerate(gone):
                if lines:
                    drop = set(lines)
                    texts[i] = b"\n".join(x for x in texts[i].split(b"\n") if line_hash(x)[0] not in drop)
            at = part.schema.get_field_index("text")
            out = part.set_column(at, "text", pa.array(texts, pa.binary()).cast(part.schema.field(at).type))
            yield out.drop_columns(["gone"])


def clean(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """The documents that are kept, all columns, without their removed lines."""
    m = measure(docs, id_col, text_col, host_col)
    removed = stage(removed_lines(m, max_docs), "removed")
    keep = verdicts(m, removed, min_kept).where("kept").select("doc_id", "key", "host").distinct()
    gone = removed.groupBy("doc_id", "key", "host").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(*[F.col(x).alias(f"g_{x}") for x in ("doc_id", "key", "host")], "gone")
    verdict = keep.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("key") == F.col("g_key")) & (F.col("host") == F.col("g_host")), "left")
    verdict = verdict.select("doc_id", "key", "host", "gone")
    d = carried(docs, text_col)
    kept = d.join(verdict, d["row"][id_col].eqNullSafe(verdict["doc_id"]) & (text_key(d["text"]) == verdict["key"])
                  & (F.coalesce(d["row"][host_col].cast("string"), F.lit("")) == verdict["host"])).select("row", "text", "gone")
    return unpacked(kept.mapInArrow(_strip, kept.select("row", "text").schema), docs, text_col)
