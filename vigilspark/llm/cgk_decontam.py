"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit check.

Benchmark items and item-sized windows of the documents are sequences of words
(A-Z lower-cased, punctuation trimmed).  A CGK random walk reads a sequence one
symbol a step and moves on or stays by a random bit of (step, symbol); sequences
at small edit distance give walks at small Hamming distance.  A table keeps
``SAMPLED`` random steps of its own walk as a key, and windows whose key equals
an item's are candidates.  Tables are repeated until items with the allowed
edits meet with ``recall`` probability, as measured on edited copies of the
items.  Where copies meet in a table with a probability under ``LEAST_RATE`` (items
of some hundred words), no tables are made: every window that holds as many of
the item's three-word runs as a match has to hold is a candidate.  Candidates are verified by the exact edit distance in words (item
against any part of the window's surroundings): at most ``max_edits`` of the
item's words.

Windows start at every word.  Those that cannot pass the check are left out
first: an item of n words with at most k edits leaves n - 2 - 3k of its
three-word runs intact (a bound, so no match is lost; where it is not positive
every window is embedded).

The items are the one bounded side: they are taken in blocks of about
``BLOCK_BYTES`` of text, each shipped to all tasks; documents are scanned once a
block and never shuffled.

Defined cases: items and texts without words (null, empty) match nothing; items
with a null id are kept under it; repeated items give a row each; repeated rows
give a row each; ties go to the earliest position; other columns are ignored
(``decontaminate`` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, carried, received, shipped, stage, text_key, unpacked
from .words import split_words

MAX_EDITS, RECALL, SAMPLED = 0.2, 0.98, 3
SIZE_STEP = 1.25  # items are embedded by their first n words, n a power of this
BLOCK_BYTES = 16 << 20
LEAST_RATE = 0.05  # of meeting in a table; under it candidates are found exactly
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#-_/\\`~"
END = 0  # symbol behind a window's end


def item_words(text) -> list[str]:
    w = split_words(pa.array([text], pa.string()))
    return [x for x in pc.ascii_trim(w.words.cast(pa.string()), PUNCTUATION).take(pa.array(w.codes)).to_pylist() if x] if len(w.codes) else []


class Walk:
    """One table: a CGK walk of 2n steps over windows of n symbols, and the
    steps it keeps."""

    def __init__(self, size: int, rng):
        self.size = size
        steps = 2 * size
        self.at = np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))
        self.odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(0, 1 << 63, len(self.at), dtype=np.uint64) | np.uint64(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Keys of the windows at ``starts`` (never read at ``stops`` or behind)."""
        pos, key = starts.copy(), np.zeros(len(starts), np.uint64)
        stops = np.minimum(stops, starts + self.size)
        padded = np.append(symbols, END).astype(np.uint64)
        k = 0
        for j in range(int(self.at[-1]) + 1):
            s = padded[np.where(pos < stops, pos, len(symbols))]
            if j == self.at[k]:
                key = (key ^ s) * self.mix[k]
                key ^= key >> np.uint64(29)
                k += 1
            pos += (((s + np.uint64(1)) * self.odd[j]) >> np.uint64(40) & np.uint64(1)).astype(pos.dtype)
        return key


def edited(words: list[int], k: int, rng, fresh: int) -> list[int]:
    out = list(words)
    for _ in range(k):
        i, kind = int(rng.integers(len(out))), rng.integers(3)
        if kind == 0:
            out[i] = fresh
        elif kind == 1:
            out.insert(i, fresh)
        elif len(out) > 1:
            del out[i]
    return out


def tables_for(items: list[list[int]], size: int, recall: float, max_edits: float, rng) -> list[Walk] | None:
    """As many tables as copies of the items with the allowed edits need to
    collide with probability ``recall`` (at least; measured); None where they
    meet in less than ``LEAST_RATE`` of the tables."""
    probe = [items[i] for i in rng.permutation(len(items))[:50]]
    met = tried = 0
    for round_ in range(200):  # walks differ much, so many of them
        if round_ % 10 == 0:
            both = [x for it in probe for x in (it, edited(it, int(max_edits * len(it)), rng, int(rng.integers(1 << 40, 1 << 41))))]
            flat, ends = np.array([s for x in both for s in x], np.int64), np.cumsum([len(x) for x in both])
            starts = np.append(0, ends[:-1])
        keys = Walk(size, rng).keys(flat, starts, ends)
        met, tried = met + int((keys[::2] == keys[1::2]).sum()), tried + len(probe)
    p = met / tried
    if p < LEAST_RATE:
        return None
    n = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
    return [Walk(size, rng) for _ in range(n)]


class Index:
    """The items of a block: vocabulary, three-word runs, tables by size class."""

    def __init__(self, items: list[tuple[object, list[str]]], recall=RECALL, max_edits=MAX_EDITS, seed=7):
        rng = np.random.default_rng(seed)
        self.max_edits = max_edits
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary = sorted({x for _, w in self.items for x in w})
        code = {x: k + 1 for k, x in enumerate(self.vocabulary)}  # 0 is END
        self.words = [[code[x] for x in w] for _, w in self.items]
        self.base = len(self.vocabulary) + 1
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            size = max(1, math.floor(SIZE_STEP ** math.floor(math.log(len(w) + 1e-9, SIZE_STEP) + 1e-9)))
            by_size.setdefault(min(size, len(w)), []).append(k)
        self.classes = []
        for size, members in sorted(by_size.items()):
            own = [self.words[k] for k in members]
            runs = np.unique(np.array([self.run(*w[i:i + 3]) for w in own for i in range(len(w) - 2)], np.int64))
            intact = min(len(w) - 2 - 3 * int(max_edits * len(w)) for w in own)
            reach = max(len(w) + int(max_edits * len(w)) for w in own)
            walks = tables_for(own, size, recall, max_edits, rng)
            listed = None
            if walks is None:
                pairs = sorted({(self.run(*self.words[k][i:i + 3]), k) for k in members for i in range(len(self.words[k]) - 2)})
                listed = np.array([r for r, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64), members
            tables = []
            for walk in walks or []:
                flat, lens = np.array([x for w in own for x in w], np.int64), np.array([len(w) for w in own])
                ends = np.cumsum(lens)
                keys = walk.keys(flat, ends - lens, ends)
                order = np.argsort(keys, kind="stable")
                tables.append((walk, keys[order], np.array(members)[order]))
            self.classes.append((size, runs, intact, reach, tables, listed))

    def run(self, a, b, c):
        return (a * self.base + b) * self.base + c

    def intact(self, item: int) -> int:
        """Three-word runs of the item that any match holds, at least."""
        n = len(self.words[item])
        return n - 2 - 3 * int(self.max_edits * n)

    def by_runs(self, listed, at, codes, starts, reach, owner, offsets):
        """(text, item, starts) that cover every window with as many of an item's
        runs as a match holds.  ``at``, ``codes``: the text's runs; ``starts``:
        windows of the class that can match."""
        run, item, members = listed
        edge = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + reach, offsets[owner[starts] + 1]), -1)
        inside = np.cumsum(edge)[at] > 0
        at, codes = at[inside], codes[inside]
        lo = np.searchsorted(run, codes, "left")
        count = np.searchsorted(run, codes, "right") - lo
        items = item[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        places = np.repeat(at, count)
        order = np.lexsort((places, items))
        items, places = items[order], places[order]
        for m in members:
            need, longest = self.intact(m), len(self.words[m]) + int(self.max_edits * len(self.words[m]))
            if need <= 0:  # the bound says nothing: whole texts
                for text in np.flatnonzero(np.diff(offsets)):
                    yield int(text), m, range(int(offsets[text]), int(offsets[text + 1]), len(self.words[m]))
                continue
            own = places[np.searchsorted(items, m, "left"):np.searchsorted(items, m, "right")]
            last = own[need - 1:]
            first = own[:len(last)]
            fits = (last - first < longest) & (owner[first] == owner[last])
            for a, b in zip(first[fits].tolist(), last[fits].tolist()):
                yield int(owner[a]), m, (max(int(offsets[owner[a]]), b - longest + 1), a)

    def matches(self, symbols: np.ndarray, offsets: np.ndarray):
        """(text, item, edits, first word) of the texts whose symbols lie between
        ``offsets``."""
        n = len(symbols)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        known = (symbols > 0) & (symbols < self.base)
        whole = np.zeros(n, bool)
        if n > 2:
            whole[:-2] = known[:-2] & known[1:-1] & known[2:] & (owner[:-2] == owner[2:])
        at = np.flatnonzero(whole)
        codes = self.run(symbols[at], symbols[at + 1], symbols[at + 2])
        near: dict[tuple[int, int], list[int]] = {}
        for size, runs, intact, reach, tables, listed in self.classes:
            if intact > 0:
                place = np.searchsorted(runs, codes)
                hit = np.zeros(n + 1, np.int64)
                hit[1 + at[runs[np.minimum(place, len(runs) - 1)] == codes]] = 1
                if not hit.any():
                    continue
                total = np.cumsum(hit)
                starts = np.arange(n)
                starts = starts[total[np.minimum(starts + reach, offsets[owner + 1])] - total[starts] >= intact]
            else:
                starts = np.arange(n)
            if not len(starts):
                continue
            if listed is not None:
                for text, m, s in self.by_runs(listed, at, codes, starts, reach, owner, offsets):
                    near.setdefault((text, m), []).extend(s)
                continue
            stops = offsets[owner[starts] + 1]
            for walk, keys, members in tables:
                got = walk.keys(symbols, starts, stops)
                lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                for w in np.flatnonzero(hi > lo):
                    s = int(starts[w])
                    for m in members[lo[w]:hi[w]]:
                        near.setdefault((int(owner[s]), int(m)), []).append(s)
        for (text, item), at_words in sorted(near.items()):
            first, last = int(offsets[text]), int(offsets[text + 1])
            w = self.words[item]
            k = int(self.max_edits * len(w))
            best = None
            for lo, hi in regions(at_words, len(w) + 2 * k, k, first, last):
                found = closest(w, symbols[lo:hi].tolist(), k)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo - first + found[1])
            if best:
                yield text, item, best[0], best[1]


def regions(starts, reach, back, first, last):
    """Merged surroundings of the windows at ``starts``."""
    out = []
    for s in sorted(set(starts)):
        lo, hi = max(first, s - back), min(last, s + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def distances(pattern, text):
    """Edit distance of ``pattern`` to the best part of ``text`` that ends at each
    position (bit-parallel, any length)."""
    m = len(pattern)
    peq: dict = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for x in text:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        out.append(score)
    return out


def closest(pattern, text, most: int):
    """(edits, start) of the part of ``text`` closest to ``pattern`` if within
    ``most`` edits; the earliest end, then the latest start."""
    d = distances(pattern, text)
    best = min(d, default=most + 1)
    if best > most:
        return None
    end = d.index(best)
    back = distances(pattern[::-1], text[end::-1])
    return best, end - back.index(best)


def _search(index):
    def run(batches):
        ix = received(index)
        vocabulary = pa.array(ix.vocabulary, pa.string())
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = split_words(part.column("text"))
                if not len(w.codes):
                    continue
                trimmed = pc.ascii_trim(w.words.cast(pa.string()), PUNCTUATION)
                place = pc.index_in(trimmed, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                symbol = np.where(place >= 0, place + 1, ix.base + np.arange(len(place)))
                blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
                symbols, offsets = symbol[w.codes], w.offsets
                if blank.any():  # punctuation alone is no word
                    real = ~blank[w.codes]
                    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
                    symbols = symbols[real]
                found = list(ix.matches(symbols, offsets))
                if found:
                    t, i, e, s = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(t)), part.column("key").take(pa.array(t)), pa.array([ix.items[k][0] for k in i], pa.int64()), pa.array(e, pa.int64()),
                         pa.array([len(ix.words[k]) for k in i], pa.int64()), pa.array(s, pa.int64())],
                        ["doc_id", "key", "item_id", "edits", "item_words", "first_word"])
    return run


def blocks(benchmark: DataFrame, item_id="item_id", text_col="text"):
    """Lists of (item, text) that hold about BLOCK_BYTES each."""
    b = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n if size else 0):
        yield [tuple(x) for x in b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text",
            max_edits: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, item_id, edits, item_words, first_word): for each document
    and item, the closest passage within the allowed edits."""

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, item_id long, edits long, item_words long, first_word long"
    out = None
    for block in blocks(benchmark, item_id, item_text):
        index = Index([(i, item_words(t)) for i, t in block], recall, max_edits)
        if index.items:
            shared = shipped(docs.sparkSession, index)
            got = stage(src.mapInArrow(_search(shared), schema), "matches")  # one index is alive at a time
            shared.destroy()
            out = got if out is None else out.union(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The documents without a benchmark passage, all columns."""

    found = stage(matches(docs, benchmark, id_col, text_col, **how).select("doc_id", "key").distinct(), "leaks")
    d = carried(docs, text_col)
    clean = d.join(found, d["row"][id_col].eqNullSafe(found["doc_id"]) & (text_key(d["text"]) == found["key"]), "left_anti")
    return unpacked(clean, docs, text_col)
