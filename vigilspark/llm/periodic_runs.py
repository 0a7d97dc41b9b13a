"""Periodic runs of words by maximal pairs.

A run is a stretch of words with smallest period q (words q apart are identical),
at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` long, that no neighbouring word extends.
If a run starts at s and is n long, the suffixes at s and s + q have exactly
L = n - q words in common, and the words left of them differ: they are a maximal
pair.  The other way, a maximal pair at distance q with L >= 3 * q and L >= 5 (the
length constraints) is a run with a period q, maximal on both sides; where several
pairs give the same stretch, the least distance is its smallest period.  So runs
are enumerated as pairs, and none is ever extended.

The suffixes of all texts of a slice are ordered by prefix doubling (suffixes that
share no five words with another of their text drop out as soon as that shows),
the common prefixes of neighbours follow from the ranks, and the intervals of
equal prefix length are walked bottom-up.  An interval's class lists hold its
suffixes by the word on their left, kept as one list in text order with each
suffix's class beside it; if an interval's two lists have one class in common and
no other, no pair can be maximal and they are only put together.  Otherwise each
suffix of the shorter list looks up its neighbours in the longer within the
distance that the prefix allows: two suffixes of a run are neighbours there, for a
third between them would make the period smaller.  Each suffix changes lists
O(log n) times.

Defined cases: a null text has no words and no runs; a text is never cut; repeated
rows give a row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .words import split_words

MIN_LENGTH, MIN_EXPONENT = 6, 4
LEAST_PREFIX = 5  # of the pair of a run: 6 - 1 at period 1, 8 - 2 at period 2
WHITE = r"[\x20\x09-\x0D]+"


def suffix_order(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST_PREFIX):
    """(positions, prefixes): the suffixes that share ``least`` words or more with another of
    their text, in order, and the words that each shares with the one before."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max()) + 1) + codes
    levels, active, shared = [np.zeros(n, np.int64)], np.arange(n), 1
    kept = none
    while len(active):
        rank = levels[-1]
        if len(levels) > 1:
            after = active + shared
            second = np.where(after < end[active], rank[np.minimum(after, n - 1)], -1)
            key = rank[active] * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        ordered, at = key[order], active[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        group = rank[at]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        base = np.maximum.accumulate(np.where(new_group, np.arange(len(at)), 0))
        new = rank.copy()
        new[at] = group + first - base
        alone = fresh & np.concatenate([fresh[1:], [True]])
        if len(levels) > 1:
            shared *= 2
        levels.append(new)
        active = np.sort(at[~alone])
        if shared < least:
            kept = active
    if not len(kept):
        return none, none
    kept = kept[np.argsort(levels[-1][kept], kind="stable")]
    common = np.zeros(len(kept), np.int64)
    i, j = kept[:-1], kept[1:]
    width = 1 << (len(levels) - 2)
    for rank in levels[:0:-1]:
        a, b = i + common[1:], j + common[1:]
        inside = (a < end[i]) & (b < end[j])
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        common[1:][same] += width
        width >>= 1
    return kept, common


def maximal_pairs(positions: np.ndarray, prefixes: np.ndarray, left: np.ndarray, least: int = LEAST_PREFIX, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(i, j, common words) of the maximal pairs with ``least`` common words or more and
    common words >= (exponent - 1) * (j - i)."""
    out = []

    def merged(one, two, common):
        (a, a_class), (b, b_class) = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
        if a_class is None or a_class != b_class:
            reach, size = common // (exponent - 1), len(a)
            for x in b:
                k = bisect_left(a, x)
                word = left[x]
                if k < size and a[k] - x <= reach and left[a[k]] != word:
                    out.append((x, a[k], common))
                if k and x - a[k - 1] <= reach and left[a[k - 1]] != word:
                    out.append((a[k - 1], x, common))
        if len(b) * 32 < len(a):
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a, (a_class if a_class == b_class else None)

    left = left.tolist()
    at, after = positions.tolist(), prefixes.tolist()[1:] + [0]
    open_lists = []  # (class lists, common words with the next suffix), common words rising
    for x, common in zip(at, after):
        node = ([x], left[x])
        while open_lists and open_lists[-1][1] >= common:
            node = merged(open_lists[-1][0], node, open_lists.pop()[1])
        if common >= least:
            open_lists.append((node, common))
    return out


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST_PREFIX, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted; starts count in the text."""
    positions, prefixes = suffix_order(codes, offsets, least)
    left = np.empty(len(codes) + 1, np.int64)
    left[1:] = codes
    left[offsets[:-1]] = -1  # nothing stands before a text
    pairs = np.array(maximal_pairs(positions, prefixes, left[:len(codes)], least, exponent), np.int64).reshape(-1, 3)
    if not len(pairs):
        return np.zeros((0, 4), np.int64)
    period = pairs[:, 1] - pairs[:, 0]
    text = np.searchsorted(offsets, pairs[:, 0], "right") - 1
    rows = np.stack([text, pairs[:, 0] - offsets[text], pairs[:, 2] + period, period], axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(batches):
    for batch in batches:
        for part in by_bytes(batch, "text"):
            w = split_words(part.column("text"), lower=False)
            found = runs_of(w.codes, w.offsets)
            # words inside a run after its first period go
            change = np.zeros(len(w.codes) + 1, np.int64)
            base = w.offsets[found[:, 0]] + found[:, 1]
            np.add.at(change, base + found[:, 3], 1)
            np.add.at(change, base + found[:, 2], -1)
            keep = np.cumsum(change[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), w.words.take(pa.array(w.codes[keep])))
            runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(part.num_rows + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.offsets)), lists, pc.binary_join(kept, " ")],
                                             ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; in order), and
    collapsed: the text's words, each run cut to its first period, joined by spaces."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_runs, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, "
                                 "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text; for every tenth value of the id's checksum its words, periodic from some word on."""
    words = F.array_remove(F.split(text, WHITE), "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.floor((n - a) / p) + 1
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int"))), 1, (n - a).cast("int"))
    rewritten = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), rewritten).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """The runs of each document as counts and digests, with the run of greatest exponent
    (exact fractions; ties: smallest start, then period)."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                     F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
