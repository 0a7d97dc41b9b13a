"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens (white-space words) of a slice of texts are walked in
sorted order, which is a depth-first walk of their trie: the unigram forward
score of every shared prefix is computed once, and each pre-token's terminal
stores the token count of its best segmentation.  A document's count is the sum
over its pre-tokens.  Nothing is shuffled: a task keeps the terminals of its
latest pre-tokens, at most ``KEPT``.

Scores are those of an existing vocabulary, by rank (see ``trie.zipf_scores``).

Defined cases: a null or empty text has no tokens; characters outside the
vocabulary count one token per UTF-8 byte; repeated rows give a row each; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .trie import Lattice, best_counts, load_pieces, zipf_scores
from .words import split_words

KEPT = 300_000


def vocabulary_lattice(path: str) -> Lattice:
    pieces = load_pieces(path)
    return Lattice(pieces, zipf_scores(len(pieces)), math.log(1e-4 / 256))


def _count(path):
    def run(batches):
        lattice, terminals = vocabulary_lattice(path), {}
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = split_words(part.column("text"), lower=False)
                words, owner = w.words.to_pylist(), w.owner
                used = np.bincount(w.codes, minlength=len(words)) > 0
                new = sorted(x for x, u in zip(words, used) if u and x not in terminals)
                if len(terminals) + len(new) > KEPT:
                    terminals = {x: terminals[x] for x in words if x in terminals}
                terminals.update(zip(new, best_counts(new, lattice)))
                score, tokens = np.array([terminals.get(x, (0.0, 0)) for x in words] or [(0.0, 0)]).T
                sums = [np.bincount(owner, weights=v[w.codes], minlength=part.num_rows) if len(owner) else np.zeros(part.num_rows) for v in (tokens, score)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.offsets), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])],
                                                 ["doc_id", "n_pretokens", "n_tokens", "score"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row: doc_id, n_pretokens, n_tokens, score (natural log of the
    best segmentations)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_count(vocabulary), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, score double")
