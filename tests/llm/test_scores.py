"""Operators 1, 2, 4, 6, 8: brute-force versions, odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD, prose
from vigilspark.llm import byte_bpe, line_quality, lm_lattice, ordinal_toxicity, registry, trie, trie_counts
from vigilspark.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PIECES = registry.tokenizer("piece_bpe_32k.model")
RANKS = registry.tokenizer("byte_bpe_50k.tiktoken")


def all_segmentations(x, lattice):
    if not x:
        return [(0.0, 0)]
    return [(s + t, n + k) for i, _, s, n in lattice.arcs(x, len(x)) for t, k in all_segmentations(x[:i], lattice)]


def test_forward_sum_counts_every_segmentation():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bc", "abc", "c"]
    lattice = trie.Lattice(pieces, [math.log(0.1)] * len(pieces), math.log(0.001))
    words = sorted(["abc", "ab", "abcabc", "aXc", "é", "b"])
    got = trie.forward_sums(words, lattice)
    best = trie.best_counts(words, lattice)
    for w, g, (s, n) in zip(words, got, best):
        ways = all_segmentations("▁" + w, lattice)
        assert g == pytest.approx(math.log(sum(math.exp(x) for x, _ in ways)))
        assert s == pytest.approx(max(x for x, _ in ways))
        assert n == min(k for x, k in ways if x == pytest.approx(s))


def test_expected_counts_equal_brute_force():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    scores = [math.log(p) for p in (0.2, 0.3, 0.1, 0.25, 0.1)]
    lattice = trie.Lattice(pieces, scores, math.log(0.001))
    words, weights = ["aab", "ab", "b"], [2.0, 1.0, 3.0]
    got = [0.0] * 6
    trie.forward_sums(words, lattice, weights, got)

    def ways(x):
        if not x:
            return [(1.0, [])]
        return [(math.exp(s) * p, used + [i]) for st, i, s, _ in lattice.arcs(x, len(x)) for p, used in ways(x[:st])]
    want = [0.0] * 6
    for w, c in zip(words, weights):
        all_ways = ways("▁" + w)
        total = sum(p for p, _ in all_ways)
        for p, used in all_ways:
            for i in used:
                want[i] += c * p / total
    assert got == pytest.approx(want)


def test_op1_base_score_and_model(spark):
    docs = documents(spark, SF_SMALL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), ""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(x for i, ws in tokens.items() if not held[i] for x in ws)
    N, V = sum(c.values()), len(c)
    got = {r.doc_id: r for r in registry.op1_lattice_likelihood(spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens[i]), N)
        assert r.n_known == sum(c[x] > 0 for x in tokens[i])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (N + V + 1)) for x in tokens[i]))
        assert math.isfinite(r.score) and r.score < 0
    # known words: better than add-one smoothing on the whole training text
    train = [r for r in got.values() if not r.held_out]
    shuffled = sum(r.score for r in train) / sum(r.n_tokens for r in train)
    assert shuffled > sum(r.base_score for r in train) / sum(r.n_tokens for r in train) - 0.3


def test_op1_model_is_a_distribution(spark, make):
    """Whole-word and lattice mass of all seen words stays at most one."""
    docs = make([prose(200, i) for i in range(20)])
    table, stats = lm_lattice.score_table(lm_lattice.word_counts(lm_lattice.rows(docs)), PIECES, 1)
    assert 0.5 < sum(10 ** r.model for r in table.collect()) <= 1 + 1e-9


def test_op1_odd_inputs(spark, make):
    docs = make([*ODD, "word", "word"]).withColumn("word", F.lit(1)).withColumn("key", F.lit("k"))
    extra = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4")).withColumn("doc_id", F.lit(None).cast("long"))
    got = lm_lattice.score_documents(docs.unionByName(extra), PIECES).collect()
    assert len(got) == len(ODD) + 4
    assert all(math.isfinite(r.score) for r in got)
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 2 and null[0] == null[1] and not null[0].held_out
    assert lm_lattice.score_documents(docs.limit(0), PIECES).count() == 0


def brute_quality(rows):
    """rows: (id, text, host) -> {id: (measures, failed, kept)}"""
    out, holders = {}, {}
    norm = lambda x: b" ".join(x.encode().lower().split())
    for i, t, h in rows:
        for x in {norm(x) for x in (t or "").split("\n")} - {b""}:
            holders.setdefault((h, x), {}).setdefault(t, []).append(i)
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lost = 0
        for x in t.split("\n"):
            own = holders.get((h, norm(x)), {})
            if len(own) > line_quality.MAX_DOCS and i != min(min(v) for v in own.values()):
                lost += len(x.encode().split())
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), failed, not failed and len(w) - lost >= 0.5 * len(w))
    return out


def test_op2_equals_brute_force(spark, make):
    shared, passage = prose(12, 1), prose(70, 2)
    texts = [prose(60 + i, 10 + i) + "\n" + shared for i in range(40)] + [passage + "\n" + prose(20, 90 + i) for i in range(60)]
    texts += ["x y z " * 30, *ODD, texts[0], texts[0].upper(), shared + "\n" + shared]
    docs = make(texts)
    want = brute_quality([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = {r.doc_id: r for r in line_quality.judge(docs).collect()}
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == w, i
    assert any(not r.kept and not r.base_failed for r in got.values())
    kept = {r.doc_id: r.text for r in line_quality.clean(docs.withColumn("lines", F.lit(1))).collect()}
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert shared not in kept[10] and kept[10].split() == texts[10].split()[:-12]


def test_op2_whole_table(spark):
    docs = documents(spark, SF_SMALL)
    want = brute_quality([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = {r.doc_id: r for r in registry.op2_line_frequency(spark, SF_SMALL).collect()}
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == w


def test_op2_repeated_rows_and_empty_table(make):
    docs = make(["one two three", None])
    twice = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert line_quality.judge(twice).count() == 4
    assert line_quality.judge(docs.limit(0)).count() == 0
    assert line_quality.clean(docs.limit(0)).count() == 0


def test_op4_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    n, m = 600, 40
    x = (rng.random((n, m)) < 0.1).astype(float)
    w = np.zeros(m)
    w[:3] = 3.0
    grades = np.digitize(x @ w + rng.logistic(size=n) * 0.3, [1.5, 4.5])
    at, col = np.nonzero(x)
    got, t = ordinal_toxicity.fit_ordinal((at, col, np.ones(len(at))), grades, m, 3)
    assert got[:3].min() > 3 * np.abs(got[3:]).max() and t[0] < t[1]  # true weights: 3 / 0.3 = 10
    p = ordinal_toxicity.Model({}, t.tolist()).probabilities(x @ got)
    assert np.allclose(p.sum(axis=1), 1)
    assert (p.argmax(axis=1) == grades).mean() > 0.85


def test_op4_held_out_accuracy(spark):
    """Trained on about 2,700 labelled rows (sf0.1), judged on the other 1,350.
    A few hundred labels are too few: 0.86 of held-out rows right at sf0.01."""
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    train = F.xxhash64("doc_id") % 3 != 0
    model = ordinal_toxicity.fit(docs, labels.where(train))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    truth = labels.where(~train).select("doc_id", F.col("toxic").alias("truth"))
    got = ordinal_toxicity.score(docs, model).join(truth, "doc_id").collect()
    hit, said, real = sum(r.severity > 0.5 and r.truth == 1 for r in got), sum(r.severity > 0.5 for r in got), sum(r.truth == 1 for r in got)
    assert hit / said > 0.95 and hit / real > 0.75


def test_op4_odd_inputs(spark, make):
    docs = make(ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = ordinal_toxicity.score(docs, ordinal_toxicity.fit(docs, none)).collect()
    assert len(got) == len(ODD) and {r.severity for r in got} == {0.0}
    labels = spark.createDataFrame([(None, 1), (4, None), (4, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert ordinal_toxicity.score(docs.union(docs), ordinal_toxicity.fit(docs.union(docs), labels)).count() == 2 * len(ODD)


def test_op6_round_trip(spark, make):
    enc = byte_bpe.load_encoding(RANKS, registry.split_pattern())
    texts = [*ODD, prose(30_000, 5), " ".join(["  a\n b"] * 20_000), "é" * 70_000]
    got = {r.doc_id: r for r in byte_bpe.round_trip(make(texts), RANKS, registry.split_pattern()).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(make(ODD), RANKS, registry.split_pattern()), RANKS, registry.split_pattern())
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}


def test_op6_cuts_are_safe():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    enc = byte_bpe.load_encoding(RANKS, registry.split_pattern())

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ab1'st .\n\t  é\x1c!"), max_size=60), st.integers(1, 8))
    def same(text, chunk):
        assert byte_bpe.encode(enc, text, chunk).tolist() == enc.encode_ordinary(text)
    same()


def test_op8_equals_word_by_word(spark, make):
    lattice = trie_counts.vocabulary_lattice(PIECES)
    texts = [*ODD, prose(500, 3), prose(500, 3)]
    got = {r.doc_id: r for r in trie_counts.token_counts(make(texts), PIECES).collect()}
    for i, t in enumerate(texts):
        each = [trie.best_counts([w], lattice)[0] for w in WORD.findall(t or "")]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(each), sum(n for _, n in each))
        assert got[i].score == pytest.approx(sum(s for s, _ in each))
    assert trie_counts.token_counts(make(texts).limit(0), PIECES).count() == 0


def test_op1_scores_do_not_depend_on_the_frequent_table(spark, make, monkeypatch):
    docs = make([prose(60, k) for k in range(30)] + ODD)
    read = lambda: sorted(tuple(r) for r in lm_lattice.score_documents(docs, registry.tokenizer("piece_bpe_32k.model")).collect())
    want = read()
    for size in (1, 10):
        monkeypatch.setattr(lm_lattice, "FREQUENT", size)
        got = read()
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
