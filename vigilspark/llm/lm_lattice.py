"""Language-model scoring: subword lattice likelihood.

The pieces of an existing vocabulary weight all segmentations of a word; a
log-space forward recursion sums them to the word's marginal probability, and a
document's probability is the product over its words and the end of text
(pieces never cross white space, so the document's lattice factors there).

Scores come from the training documents: expected piece counts over all
distinct training words (``em_rounds`` rounds of expectation-maximisation,
starting from the vocabulary's rank order), and one whole-word arc for each
training word with its absolutely discounted relative frequency; the discounted
mass is what the lattice of pieces gets:

    P(w) = max(c(w) - D, 0) / N  +  D * V / N * lattice(w),   D = n1 / (n1 + 2 n2)

Defined cases: a null text is empty (one token, the end); a null id is hashed as
the empty string (so it trains); repeated rows give a row each; without training
words the lattice alone scores; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stage, text_key
from .trie import Lattice, forward_sums, load_pieces, zipf_scores
from .words import split_words

END = ""            # the end token's key among words
FREQUENT = 200_000  # words whose scores every task holds; bounds the broadcast
LONGEST_KEY = 128   # bytes of a word among them
PSEUDO_COUNT = 0.01


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       text_key(F.col(text_col)).alias("key"), held_out(F.col(id_col)).alias("held_out"))


def _count(batches):
    for batch in batches:
        for part in by_bytes(batch, "text"):
            w = split_words(part.column("text"))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            used = np.bincount(w.codes, minlength=len(w.words)) > 0
            n = np.bincount(w.codes[train[w.owner]], minlength=len(w.words))
            words = w.words.filter(pa.array(used))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words, pa.array([END], words.type)]),
                 pa.array(np.append(n[used], train.sum()), pa.int64())], ["word", "c"])


def word_counts(r: DataFrame) -> DataFrame:
    """(word, c): every distinct word of all texts with its training count, in
    word order by range partitions (prefixes meet in one partition)."""
    counted = r.select("text", "held_out").mapInArrow(_count, "word string, c long")
    totals = counted.groupBy("word").agg(F.sum("c").alias("c"))
    return stage(totals.repartitionByRange("word").sortWithinPartitions("word"), "lm-counts")


def _expectation(path, scores):
    def run(batches):
        pieces = load_pieces(path)
        lattice = Lattice(pieces, scores[:-1], scores[-1])
        total = [0.0] * (len(pieces) + 1)
        for b in batches:
            words = [x for x in b.column("word").to_pylist() if x != END]
            forward_sums(words, lattice, [1.0] * len(words), total)
        got = np.array(total)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[at])], ["piece", "n"])
    return run


def fit_pieces(counts: DataFrame, path: str, em_rounds: int) -> list[float]:
    """Natural-log piece scores, the byte score last.  Only sums per piece
    (bounded by the vocabulary) reach the driver."""
    n = len(load_pieces(path))
    scores = [*zipf_scores(n), math.log(1e-4 / 256)]
    types = counts.where("c > 0").select("word")
    for _ in range(em_rounds):
        got = types.mapInArrow(_expectation(path, scores), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        total = np.full(n + 1, PSEUDO_COUNT)
        for p, x in got.collect():
            total[p] += x
        p = total / total.sum()
        p[-1] /= 256
        scores = np.log(p).tolist()
    return scores


def _score_words(path, scores, stats):
    def run(batches):
        lattice = Lattice(load_pieces(path), scores[:-1], scores[-1])
        end = min(scores)
        N, V, D = stats["N"], stats["V"], stats["D"]
        for b in batches:
            words, c = b.column("word"), b.column("c").to_numpy(zero_copy_only=False).astype(float)
            texts = words.to_pylist()
            lat = np.array(forward_sums(texts, lattice))
            if END in texts:
                lat[texts.index(END)] = end
            if N:
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c - D, 0) / N)
                lat = np.logaddexp(whole, math.log(D * V / N) + lat)
            base = np.log10((c + 1) / (N + V + 1))
            yield pa.RecordBatch.from_arrays(
                [words, b.column("c"), pa.array(base), pa.array(lat / math.log(10))], ["word", "c", "base", "model"])
    return run


def score_table(counts: DataFrame, path: str, em_rounds: int = 2):
    """(word, c, base, model) with log10 scores, and the training statistics."""
    s = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    N, V, n1, n2 = (int(x or 0) for x in s)
    stats = {"N": N, "V": V, "D": n1 / (n1 + 2 * n2) if n1 and n2 else 0.5}
    scores = fit_pieces(counts, path, em_rounds)
    table = counts.mapInArrow(_score_words(path, scores, stats), "word string, c long, base double, model double")
    return stage(table, "lm-scores"), stats


def _frequent(table: DataFrame) -> pa.Table:
    """The scores of the end and the most frequent words: at most FREQUENT + 1 rows with keys of
    at most LONGEST_KEY bytes, so at most about 30 MB whatever the corpus."""
    top = table.where((F.octet_length("word") <= LONGEST_KEY) & (F.col("word") != END)).orderBy(F.desc("c"), "word").limit(FREQUENT)
    return table.where(F.col("word") == END).unionAll(top).toArrow()


def _score_rows(frequent):
    def run(batches):
        hot = pa.ipc.open_stream(frequent.value).read_all().combine_chunks()
        keys = hot.column("word").combine_chunks()
        c, base, model = (hot.column(x).to_numpy() for x in ("c", "base", "model"))
        at_end = pc.index(keys, pa.scalar(END, keys.type)).as_py()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = split_words(part.column("text"))
                n, owner = part.num_rows, w.owner
                at = pc.fill_null(pc.index_in(w.words.cast(keys.type), value_set=keys), -1).to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, int)
                seen = at >= 0
                of = lambda v: np.bincount(owner[seen], weights=v[at[seen]], minlength=n)
                ids, key, out = part.column("doc_id"), part.column("key"), part.column("held_out")
                # the text's own row: it meets a frequent word, spread by the text's key, zero times
                spread = np.abs(key.to_numpy(zero_copy_only=False) % len(keys))
                yield _rows(ids, key, out, keys.take(pa.array(spread)), np.zeros(n, np.int64), np.ones(n, np.int64),
                            np.diff(w.offsets) + 1, of((c > 0).astype(float)).astype(np.int64) + int(c[at_end] > 0),
                            of(base) + base[at_end], of(model) + model[at_end])
                rare, times = np.unique(owner[~seen] * max(1, len(w.words)) + w.codes[~seen], return_counts=True)
                if len(rare):
                    doc, code = np.divmod(rare, len(w.words))
                    pick, zero = pa.array(doc), np.zeros(len(rare), np.int64)
                    yield _rows(ids.take(pick), key.take(pick), out.take(pick), w.words.take(pa.array(code)).cast(keys.type),
                                times, zero, zero, zero, zero.astype(float), zero.astype(float))
    return run


def _rows(ids, key, out, word, n, copies, tokens, known, base, model):
    return pa.RecordBatch.from_arrays(
        [ids, key, out, word, pa.array(n, pa.int64()), pa.array(copies, pa.int64()), pa.array(tokens, pa.int64()),
         pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())],
        ["doc_id", "key", "held_out", "word", "n", "copies", "tokens", "known", "base_part", "model_part"])


def score_documents(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", em_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).

    Frequent words are scored inside the scan by a bounded table; only
    occurrences of the others travel to their word's row."""
    r = rows(docs, id_col, text_col)
    table, stats = score_table(word_counts(r), vocabulary, em_rounds)
    frequent = _frequent(table)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as w:
        w.write_table(frequent)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    id_type = r.schema["doc_id"].dataType.simpleString()
    if not frequent.num_rows:  # an empty corpus
        parts = r.select("doc_id", "key", "held_out", F.lit(END).alias("word"), *[F.lit(0).cast("long").alias(x) for x in ("n", "copies", "tokens", "known")],
                         *[F.lit(0.0).alias(x) for x in ("base_part", "model_part")])
    else:
        parts = r.mapInArrow(_score_rows(shared), f"doc_id {id_type}, key long, held_out boolean, word string, n long, copies long, "
                             "tokens long, known long, base_part double, model_part double")
    n = F.col("n")
    met = parts.join(table, "word").select(
        "doc_id", "key", "held_out", "copies", "tokens", (F.col("known") + F.when(F.col("c") > 0, n).otherwise(0)).alias("known"),
        (F.col("base_part") + n * F.col("base")).alias("base"), (F.col("model_part") + n * F.col("model")).alias("model"))
    sums = met.groupBy("doc_id", "key", "held_out").agg(*[F.sum(x).alias(x) for x in ("copies", "tokens", "known", "base", "model")])
    each = lambda x: (F.col(x) / F.col("copies"))
    return sums.select(
        "doc_id", "held_out", each("tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"),
        F.lit(stats["N"]).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("model").alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
