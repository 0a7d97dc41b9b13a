"""Words of a slice of texts as dictionary codes (Arrow kernels, no per-word Python)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """``words[codes[offsets[i]:offsets[i + 1]]]`` are the words of text i."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array

    @property
    def owner(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]`` of every text (null: none)."""
    t = pc.fill_null(texts, "")
    if lower:
        t = pc.ascii_lower(t)
    lists = pc.ascii_split_whitespace(t)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # leading or trailing white space leaves an empty piece
        real = codes != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return Words(codes, ends, words)
