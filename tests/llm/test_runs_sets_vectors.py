"""Operators 11, 12 and 13: brute-force versions, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import ODD, prose
from vigilspark.llm import embedding_whitening, minhash_index, periodic_runs, registry
from vigilspark.llm.common import documents
from vigilspark.sources.tables import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --------------------------------------------------------------------- 11 runs

def brute_runs(w):
    """(start, length, period) of all runs: for each period the stretches that keep it, maximal."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found[s, i - s + q] = min(q, found.get((s, i - s + q), q))
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(text, doc_id):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(w, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_pairs_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(r.randrange(1, 5)):
            n = r.randrange(0, 90)
            w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(n)]
            if r.random() < 0.6 and n:
                a = r.randrange(n)
                p = r.randrange(1, (n - a) // 3 + 2)
                for i in range(a + p, n):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.cumsum([0] + [len(x) for x in texts]))
        for d, w in enumerate(texts):
            assert [tuple(x[1:]) for x in got.tolist() if x[0] == d] == brute_runs(w)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_op11_whole_table(spark, sf):
    got = {x.doc_id: tuple(x)[1:] for x in registry.op11_periodic_runs(spark, sf).collect()}
    docs = documents(spark, sf).select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(x[0] for x in got.values()) > 0
    checked = 0
    for d in docs:
        w = planted_words(d.text, d.doc_id)
        if len(w) <= 600:  # the brute-force version takes the square of the words
            assert got[d.doc_id] == digest(w, brute_runs(w))
            checked += got[d.doc_id][0] > 0
    assert checked > (3 if sf == SF_SMALL else 20)


def test_op11_odd_inputs(spark, make):
    texts = [*ODD, "a b a b a b a b x", "y " * 6 + "z", "A a A a A a A a", "p q r " * 4 + "p q s", " ".join(["k"] * 300_000)]
    docs = make(texts).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    docs = docs.union(docs.where("doc_id = 8")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(texts) + 2 and sum(x.doc_id == 8 for x in rows) == 2 and sum(x.doc_id is None for x in rows) == 1
    got = {x.doc_id: x for x in rows}
    for i, t in enumerate(texts[:-1]):
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == len(w)
    assert got[8].collapsed == "a" and got[len(ODD)].collapsed == "a b x"
    assert [tuple(r) for r in got[len(texts) - 1].runs] == [(0, 300_000, 1)]
    # two texts alike in words never make a run together, across the slice's border
    assert got[0].collapsed == "" and periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    report = {x.doc_id: x for x in periodic_runs.report(periodic_runs.periodic_runs(docs)).collect()}
    assert tuple(report[0])[1:] == digest([], []) and report[len(texts) - 1].exponent_milli == 300_000_000


# ------------------------------------------------------------------ 12 MinHash

def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows, percent=85):
    """doc_id -> (set size, least id reachable), by comparing all pairs of texts."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    least, parent = {}, {}
    for i, s in sets:
        least[s] = min(i, least.get(s, i))
    parent = {s: s for s in least}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    by_size = sorted((s for s in least if s), key=len)
    for k, s in enumerate(by_size):
        for t in by_size[k + 1:]:
            if 100 * len(s) < percent * len(t):
                break
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(s), find(t)
                if a != b:
                    if least[a] > least[b]:
                        a, b = b, a
                    parent[b] = a
    return {i: (len(s), least[find(s)] if s else i) for i, s in sets}


def result(rows):
    return {x.doc_id: (x.n_shingles, x.component_id) for x in rows}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_op12_whole_table(spark, sf):
    rows = registry.op12_minhash_index(spark, sf).collect()
    docs = documents(spark, sf).select("doc_id", "text").collect()
    want = brute_components([(d.doc_id, d.text) for d in docs])
    assert result(rows) == want and len(rows) == len(docs)
    assert all(x.kept == (x.doc_id == x.component_id) for x in rows)
    assert len({c for _, c in want.values()}) < len(want)


def edited_group(n, words, seed):
    """Texts that grow out of each other by single edits, as a tree."""
    r = random.Random(seed)
    texts = [prose(words, seed).split()]
    for _ in range(n - 1):
        t = list(r.choice(texts))
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("nodes, hashes", [(4096, 1 << 18), (7, 900)])
def test_op12_large_groups_in_blocks(spark, make, monkeypatch, nodes, hashes):
    """Groups larger than a block give the same links; sizes, copies and borders."""
    monkeypatch.setattr(minhash_index, "BLOCK_NODES", nodes)
    monkeypatch.setattr(minhash_index, "BLOCK_HASHES", hashes)
    texts = edited_group(150, 120, 5) + edited_group(40, 60, 6) + [prose(30, 100 + k) for k in range(30)] + [prose(120, 5)] * 20
    got = result(minhash_index.near_duplicates(make(texts)).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_op12_pigeonhole():
    """Any two signatures within the radius share a key."""
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (2000, minhash_index.SYMBOLS), np.uint8)
    b = a.copy()
    for row in b:
        at = r.choice(minhash_index.SYMBOLS, minhash_index.RADIUS, replace=False)
        row[at] += r.integers(1, 256, len(at), np.uint8)
    assert ((a != b).sum(axis=1) == minhash_index.RADIUS).all()
    keys_a, keys_b = minhash_index.chunk_keys(a), minhash_index.chunk_keys(b)
    assert (keys_a == keys_b).any(axis=1).all()
    assert len(np.unique(keys_a[0])) == keys_a.shape[1]


def test_op12_threshold_is_exact(spark, make):
    """Sets of exactly 85 %, and one shingle less."""
    base = [f"w{i}" for i in range(104)]                       # 100 shingles
    def cut(a, b):
        return " ".join(base[a:b])
    texts = [cut(0, 104), cut(15, 104), cut(16, 104)]            # 85 of 100; 84 of 100 (and 84 of 85 to the second)
    got = result(minhash_index.near_duplicates(make(texts[:2])).collect())
    assert got == {0: (100, 0), 1: (85, 0)}
    got = result(minhash_index.near_duplicates(make([texts[0], texts[2]])).collect())
    assert got == {0: (100, 0), 1: (84, 1)}
    assert result(minhash_index.near_duplicates(make(texts)).collect()) == {0: (100, 0), 1: (85, 0), 2: (84, 0)}


def test_op12_odd_inputs(spark, make):
    texts = [*ODD, "A B c", "a b\tC", "a b c d", "one two three four five", "x " * 400_000, "q" * 3_000_000]
    docs = make(texts).withColumn("node", F.lit(1)).withColumn("grp", F.lit("x")).withColumn("n", F.lit(2)).withColumn("key", F.lit(3)).withColumn("root", F.lit(4))
    rows = minhash_index.near_duplicates(docs).collect()
    assert len(rows) == len(texts) and result(rows) == brute_components(list(enumerate(texts)))
    twice = minhash_index.near_duplicates(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and result(twice) == result(rows)
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert all(x.component_id is None and x.kept for x in minhash_index.near_duplicates(none).collect())
    assert result(minhash_index.near_duplicates(docs.union(none)).where("doc_id is not null").collect()) == result(rows)
    assert minhash_index.near_duplicates(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 whitening

def brute_whitening(rows, limit=16):
    """vec_id -> (n, deviation, |whitened| list), explained list; python integers and numpy."""
    x = {i: tuple(math.floor(64 * c) + 1000000 for c in v) for i, v in rows
         if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = {v: [n * a - s for a, s in zip(v, sums)] for v in fit}
    centred = np.array([apart[v] for v in fit]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:limit], vectors[:, ::-1][:, :limit]
    z = {v: row for v, row in zip(fit, centred @ vectors / np.sqrt(values))}
    return {i: (n, sum(a * a for a in apart[v]), z[v]) for i, v in x.items()}, values / np.trace(centred.T @ centred / n)


def signed_equal(a, b):
    """Columns equal up to one sign each."""
    sign = np.sign((a * b).sum(axis=0))
    np.testing.assert_allclose(a, b * sign, rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("height", [2 << 20, 8 * 64 * 7])
def test_op13_whole_table(spark, monkeypatch, height):
    monkeypatch.setattr(embedding_whitening, "BLOCK_BYTES", height)
    rows = registry.op13_embedding_whitening(spark, SF_SMALL).collect()
    want, explained = brute_whitening([(r.vec_id, r.embedding) for r in read_table(spark, SF_SMALL, "embeddings").collect()])
    assert {(x.vec_id, x.component) for x in rows} == {(i, c) for i in want for c in range(1, 17)} and len(rows) == 16 * len(want)
    assert all((x.n, x.deviation) == want[x.vec_id][:2] for x in rows)
    assert {x.identity_error for x in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-8
    ids = sorted(want)
    z = {(x.vec_id, x.component): x.whitened for x in rows}
    signed_equal(np.array([[z[i, c] for c in range(1, 17)] for i in ids]), np.array([want[i][2] for i in ids]))
    for x in rows:
        assert abs(x.explained - explained[x.component - 1]) <= 1e-6 * x.explained


def test_op13_odd_inputs(spark):
    r = random.Random(4)
    good = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    same = [(200 + k, good[3][1]) for k in range(30)] + [(3, good[3][1]), (None, good[4][1])]
    frame = spark.createDataFrame(good + bad + same, "vec_id long, embedding array<double>")
    frame = frame.withColumn("id", F.lit(1)).withColumn("at", F.lit(2)).withColumn("block", F.lit(3)).withColumn("part", F.lit(4)).withColumn("x", F.lit(5))
    rows = embedding_whitening.whiten(frame).collect()
    want, explained = brute_whitening(good + same[:30])
    assert {x.vec_id for x in rows} == {*want, None} and len(rows) == 5 * (40 + 32)
    assert {x.n for x in rows} == {40} and all(x.deviation == want[x.vec_id][1] for x in rows if x.vec_id is not None)
    z = {(x.vec_id, x.component): x.whitened for x in rows}
    ids = sorted(want)
    signed_equal(np.array([[z[i, c] for c in range(1, 6)] for i in ids]), np.array([want[i][2] for i in ids]))
    assert embedding_whitening.whiten(frame.limit(0)).count() == 0
    assert embedding_whitening.whiten(frame.where("vec_id >= 100 and vec_id < 200")).where("vec_id <> 104").count() == 0
    assert embedding_whitening.whiten(frame.where("vec_id >= 200")).count() == 0  # one distinct vector: no variance
    assert embedding_whitening.whiten(frame.where("vec_id < 2")).count() == 2     # two: one component
