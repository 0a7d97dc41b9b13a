"""Operators 3, 5, 7, 9, 10 and the pipeline: brute-force versions, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import ODD, prose
from vigilspark.llm import cgk_decontam, chat_windows, components, line_quality, pii_disclosure, registry, simhash_cover, url_rules
from vigilspark.llm.common import documents
from vigilspark.sources.tables import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ------------------------------------------------------------ 3 decontamination

def edit_distance_within(p, t):
    """Least edits of p to any part of t (plain dynamic programming)."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(200):
        p, t = [r.randrange(4) for _ in range(r.randrange(1, 80))], [r.randrange(4) for _ in range(r.randrange(0, 90))]
        want = edit_distance_within(p, t)
        assert min(cgk_decontam.distances(p, t), default=len(p)) == want or want == len(p)
        found = cgk_decontam.closest(p, t, len(p) - 1)
        if want < len(p):
            assert found[0] == want


def test_op3_recall_and_precision(spark, make):
    items = [prose(n, n) for n in range(15, 59, 2)]
    r, texts, truth = random.Random(5), [], []
    for k in range(300):
        body = prose(150, 1000 + k).split()
        if k % 3 == 0:
            it = items[k % len(items)].split()
            for _ in range(r.randrange(int(0.2 * len(it)) + 1)):
                i = r.randrange(len(it))
                it = r.choice([it[:i] + ["zzz"] + it[i + 1:], it[:i] + it[i + 1:], it[:i] + ["yyy"] + it[i:]])
            at = r.randrange(len(body))
            body[at:at] = it
        texts.append(" ".join(body))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(97, None), (98, ""), (99, " . ")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in cgk_decontam.matches(make(texts), bench).collect()}
    for d, t in enumerate(texts):
        tw = cgk_decontam.item_words(t)
        for i, it in enumerate(items):
            iw = cgk_decontam.item_words(it)
            e = edit_distance_within(iw, tw)
            if e <= int(0.2 * len(iw)):
                truth.append((d, i))
                assert got.get((d, i), e) == e
    assert set(got) <= set(truth)
    assert len(got) / len(truth) >= 0.95


def test_op3_whole_table(spark):
    """Every item-sized passage that plain dynamic programming finds."""
    docs, bench = documents(spark, SF_SMALL), read_table(spark, SF_SMALL, "benchmark")
    got = {(x.doc_id, x.item_id): x.edits for x in registry.op3_cgk_decontamination(spark, SF_SMALL).collect()}
    items = {x.item_id: cgk_decontam.item_words(x.text) for x in bench.collect()}
    want = {}
    for d in docs.collect():
        ids = {}
        words = [ids.setdefault(x, len(ids)) for x in cgk_decontam.item_words(d.text)]
        for i, w in items.items():
            e = min(cgk_decontam.distances([ids.get(x, -1) for x in w], words), default=len(w))
            if e <= int(0.2 * len(w)):
                want[d.doc_id, i] = e
    assert want and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(want[k] == e for k, e in got.items())


def test_op3_long_items_lose_no_copy():
    """Items whose edited copies seldom meet in a table."""
    r = random.Random(8)
    items = [prose(n, n).split() for n in (600, 800)]
    ix = cgk_decontam.Index([(i, it) for i, it in enumerate(items)])
    code = {x: k + 1 for k, x in enumerate(ix.vocabulary)}
    texts, want = [], {}
    for k in range(24):
        it, body = list(items[k % 2]), prose(300, 900 + k).split()
        for _ in range(int(0.2 * len(items[k % 2]))):
            i = r.randrange(len(it))
            it[i:i + 1] = r.choice([["zzz"], [], ["yyy", it[i]]])
        texts += [body[:150] + it + body[150:], body]
    for t, x in enumerate(texts):
        for i, it in enumerate(items):
            d = min(cgk_decontam.distances(it, x))
            if d <= int(0.2 * len(it)):
                want[t, i] = d
    symbols = np.array([code.get(x, ix.base) for x in sum(texts, [])], np.int64)
    got = {(t, i): e for t, i, e, _ in ix.matches(symbols, np.cumsum([0] + [len(x) for x in texts]))}
    assert len(want) >= 24 and got == want


def test_op3_odd_inputs(spark, make):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "word")], "item_id long, text string")
    docs = make([*ODD, "so one two three go"])
    got = cgk_decontam.matches(docs.withColumn("item_id", F.lit(5)), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} >= {(len(ODD), 1), (4, None)}
    assert cgk_decontam.matches(docs, bench.limit(0)).count() == 0
    assert cgk_decontam.matches(docs.limit(0), bench).count() == 0
    kept = {x.doc_id for x in cgk_decontam.decontaminate(docs, bench).collect()}
    assert 4 not in kept and len(ODD) not in kept and 0 in kept


# -------------------------------------------------------------------- 5 chat

def brute_chat(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said)


def test_op5_equals_brute_force(spark):
    rows = read_table(spark, SF_ORACLE, "conversations").collect()
    turns = {}
    for x in sorted(rows, key=lambda x: (x.conv_id, x.turn)):
        turns.setdefault(x.conv_id, []).append((x.role, x.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {x.conv_id: x for x in registry.op5_chat_windows(spark, SF_ORACLE).collect()}
    assert {i: brute_chat(t) for i, t in turns.items()} == {i: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for i, x in got.items()}


def test_op5_windows_keep_the_contract(spark):
    turns = [("system", "be brief")] + [("user" if k % 2 else "assistant", prose(30 + 17 * k % 90, k)) for k in range(60)] + [("assistant", prose(400, 1))]
    ws = list(chat_windows.windows(turns, budget=200, history=2))
    assert [(r, t) for _, new, _ in ws for r, t, _ in new] == turns
    for k, (rep, new, total) in enumerate(ws):
        assert total == sum(t[2] for t in rep + new)
        assert total <= 200 or len(new) == 1
        assert k == 0 or rep[0][:2] == turns[0]
        assert len(rep) <= 3
    text, spans = chat_windows.render(*ws[3][:2])
    assert [chat_windows.unescape(text[a:b]) for a, b in spans] == [t for r, t, _ in ws[3][1] if r == "assistant"]


def test_op5_escapes_are_reversible():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    part = st.sampled_from(["\\", "<", ">", "/", "s", "[", "]", "INST", "</s>", "[INST]", "<s>", "\n", "x", "<<SYS>>", "🙂"])

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(st.lists(part).map("".join), st.lists(part).map("".join)), max_size=4))
    def back(turns):
        text, spans = chat_windows.render([], [(r, t, 1) for r, t in turns])
        assert chat_windows.parse(text) == turns
        assert not any(c in chat_windows.escape(t) for c in chat_windows.CONTROL for _, t in turns)
    back()


def test_op5_odd_inputs(spark):
    rows = [(None, 1, None, None), (None, None, "user", "a"), (7, 2, "assistant", None), (7, 2, "assistant", None), (7, 1, "a\nb\\", "x" * 9000), (8, 0, "assistant", "é\n\n")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    got = {x.conv_id: x for x in chat_windows.read_back(chat_windows.format_conversations(c, budget=50)).collect()}
    want = {None: [("user", "a"), ("", "")], 7: [("a\nb\\", "x" * 9000), ("assistant", ""), ("assistant", "")], 8: [("assistant", "é\n\n")]}
    assert {i: brute_chat(t) for i, t in want.items()} == {i: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for i, x in got.items()}
    assert chat_windows.read_back(chat_windows.format_conversations(c.limit(0))).count() == 0


# ----------------------------------------------------------------- 7 SimHash

def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """{id: fingerprint} -> {id: least id reachable}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_covering_masks_cover_every_difference():
    r = random.Random(1)
    for radius in (1, 2, 4):
        ms = simhash_cover.masks(radius)
        for _ in range(500):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(diff & m == 0 for m in ms)
        for m in ms:  # and again on the bits that a table leaves out
            free = ((1 << 64) - 1) & ~m
            bits = [b for b in range(64) if free >> b & 1]
            for _ in range(20):
                diff = sum(1 << b for b in r.sample(bits, radius))
                assert any(diff & d == 0 and d & m == m for d in simhash_cover.masks(radius, free))


def test_covering_masks_go_on_with_few_bits(spark):
    """A bucket dealt again keeps more bits each time, so that dealing ends."""
    for radius in (1, 2, 4):
        for n in range(radius + 1, 65):
            free = (1 << n) - 1
            assert all(m & free for m in simhash_cover.masks(radius, free)), (radius, n)
    nodes = spark.createDataFrame([(x,) for x in range(64)], "fp long")
    roots = components.components(simhash_cover.links(nodes, 4, 20)).collect()
    assert {x.node: x.root for x in roots if x.node} == {x: 0 for x in range(1, 64)}


def test_op7_equals_brute_force(spark):
    docs = documents(spark, SF_SMALL).union(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_cover.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("most", [4096, 60])
def test_op7_hot_buckets_lose_no_link(spark, most):
    """Many fingerprints in one ball: buckets that are dealt again give the same components."""
    r = random.Random(9)
    centre = r.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 9))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    prints = {i: p for i, p in enumerate(sorted(prints))}
    nodes = spark.createDataFrame([(simhash_cover._signed(p),) for p in prints.values()], "fp long")
    links = simhash_cover.links(nodes, 4, most)
    pairs = links.collect()
    unsigned = lambda x: x % (1 << 64)
    roots = {unsigned(x.node): unsigned(x.root) for x in components.components(links).collect()}
    want = brute_components(prints)
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in set(of.values())}
    assert groups({p: roots.get(p, p) for p in prints.values()}) == groups({prints[i]: prints[j] for i, j in want.items()})
    assert len(pairs) < 31 * 31 * len(prints)


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "u long, v long")
    got = {x.node: x.root for x in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.components(e.limit(0)).count() == 0


def test_op7_deduplicate(spark, make):
    texts = [prose(80, 1), prose(80, 1), prose(80, 2), None, "", prose(80, 3), prose(80, 3) + " x"]
    docs = make(texts).withColumn("fp", F.lit(0)).withColumn("root", F.lit("r"))
    again = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    kept = sorted((x.doc_id for x in simhash_cover.deduplicate(again).collect()), key=str)
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert kept == sorted(set(brute_components(prints).values()), key=str)
    alone = docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash_cover.deduplicate(alone.union(alone)).count() == 1
    got = simhash_cover.near_duplicates(alone.union(alone)).collect()
    assert len(got) == 2 and got[0].component_id is None
    assert simhash_cover.near_duplicates(docs.limit(0)).count() == 0
    assert simhash_cover.deduplicate(docs).columns == docs.columns


# --------------------------------------------------------------------- 9 PII

def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, p, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == "phone" or luhn(d)):
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c_d@e.f", "x.y+z%1@a-b.c.d. q@w @q.w e@.x", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.00 1.2.3 1234.5.6.7", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 5", "+1 (555) 123-4567 +12 345 +1+2 +1.......9",
          "é𝒳 a@b.cd 𝒳 10.0.0.1é", "a" * 3000 + "@b.c " + "1" * 3000 + " " + "1." * 500, "a@b" + ".c" * 3000, "1 " * 4000, "+1 555 123 4567 4111111111111111 mail +1 (988) 555-2485"]


def test_op9_base_spans(spark, make):
    texts = [*ODD, *TRICKY]
    got = {x.doc_id: x for x in pii_disclosure.report(make(texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (t or "")[:50]
        assert got[i].spans == s
        assert [got[i][f"n_{k}"] for k in pii_disclosure.KINDS] == [sum(x[0] == k for x in want) for k in pii_disclosure.KINDS]


def test_op9_whole_table(spark):
    got = {x.doc_id: x for x in registry.op9_pii_disclosure(spark, SF_ORACLE).collect()}
    for r in documents(spark, SF_ORACLE).collect():
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert got[r.doc_id].spans.startswith(s)


def test_op9_disclosing_terms(spark, make):
    r = random.Random(4)
    texts = [prose(60, k) for k in range(200)]
    for k in range(6):  # a nickname that stands by one address and nowhere else; a common word does too
        texts.append(f"{prose(20, 300 + k)} the Zorblax river writes from zor@mail.example.com to {r.choice(['river', 'paper'])} {prose(20, 400 + k)}")
    texts += [texts[0] + " call quibbly a@b.cd now"] * 10  # copies of one context prove nothing
    got = pii_disclosure.sanitise(make(texts).withColumn("base", F.lit(1)).withColumn("spans", F.lit(2)))
    text = {x.doc_id: x.text for x in got.collect()}
    assert got.columns[-2:] == ["base", "spans"]
    assert all("Zorblax" not in text[200 + k] and "[EMAIL]" in text[200 + k] and "river" in text[200 + k] for k in range(6))
    assert "quibbly" in text[206] and "[EMAIL]" in text[206]
    assert all(text[k] == texts[k] for k in range(200))


def test_op9_counts_in_texts(make):
    """Repeats within a text are one text; a line with equal surroundings in many texts, or near copies, are many."""
    texts = [prose(60, k) for k in range(200)]
    texts.append(" ".join(f"{prose(30, 500 + k)} the glimby writes to rep@mail.example.com {prose(30, 600 + k)}" for k in range(3)))
    line = f"{prose(20, 700)} yours Quorvex at sig@mail.example.com {prose(20, 701)}"
    texts += [f"{prose(40, 800 + k)} {line} {prose(40, 900 + k)}" for k in range(12)]
    near = [f"{prose(20, 1000 + c)} ask Wimdal by near@mail.example.com {prose(20, 1010 + c)}" for c in range(3)]
    texts += [f"{prose(40, 1100)} {near[k % 3]} {prose(40, 1200)} copy {prose(1 + k, 1300)}" for k in range(12)]
    text = {x.doc_id: x.text for x in pii_disclosure.sanitise(make(texts)).collect()}
    assert text[200].count("glimby") == 3 and text[200].count("[EMAIL]") == 3
    assert all("Quorvex" not in text[201 + k] and "Wimdal" not in text[213 + k] for k in range(12))


def test_op9_rare_names(make):
    """No least count of texts: two texts of 300 show a disclosure, one of them does not yet."""
    texts = [prose(60, k) for k in range(300)]
    texts += [f"{prose(20, 400 + k)} the Zorblax writes from zor@mail.example.com {prose(20, 500 + k)}" for k in range(2)]
    texts.append(f"{prose(20, 402)} the Quibbly writes from qui@mail.example.com {prose(20, 502)}")
    text = {x.doc_id: x.text for x in pii_disclosure.sanitise(make(texts)).collect()}
    assert all("Zorblax" not in text[300 + k] and "[TERM]" in text[300 + k] for k in range(2))
    assert "Quibbly" in text[302] and all(text[k] == texts[k] for k in range(300))


@pytest.mark.parametrize("total, n_t, want", [(100, 1, False), (10_000, 1, True), (10_000, 2, False), (10**9, 1, True)])
def test_op9_evidence_of_one_text(spark, total, n_t, want):
    d = spark.createDataFrame([(1, 1, n_t)], "n_et long, n_e long, n_t long")
    assert d.select(pii_disclosure._over(F.col("n_t"), total, pii_disclosure.GENERALISE)).first()[0] is want


def test_op9_words_cut_by_an_entity_are_no_terms(make):
    """A letter run that an entity's own letters go on with is no term of its text."""
    texts = [prose(60, k) for k in range(200)] + [f"{prose(9, 300 + k)} grüßéa@b.cd {prose(9, 400 + k)}" for k in range(4)] + ["the grüßé stands"]
    text = {x.doc_id: x.text for x in pii_disclosure.sanitise(make(texts)).collect()}
    assert text[204] == texts[204]


def test_op9_redaction_of_overlaps(make):
    texts = ["x 4111111111111111@b.cd y", "+4111111111111111 z", None, "", "a@b.cd"]
    got = {x.doc_id: x.text for x in pii_disclosure.sanitise(make(texts)).collect()}
    assert got == {0: "x [EMAIL] y", 1: "+[CARD] z", 2: None, 3: "", 4: "[EMAIL]"}
    assert pii_disclosure.sanitise(make(texts).limit(0)).count() == 0
    assert pii_disclosure.report(make(texts).union(make(texts)).withColumn("doc_id", F.lit(None).cast("long"))).count() == 10


# ------------------------------------------------------------------- 10 URLs

def brute_url(u, rules):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_op10_equals_brute_force(spark):
    pages = read_table(spark, SF_ORACLE, "pages").collect()
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in registry.op10_url_rules(spark, SF_ORACLE).collect()}
    assert got == {x.page_id: brute_url(x.url, registry.URL_RULES) for x in pages}


def test_op10_odd_inputs(spark):
    urls = [None, "", "x", "://", "http://", "http://ORG/", "http://org", "http://a.org/x://y", "a://b.c.example.ORG/en/12?q#f", "http://xorg/", "http://.org/", "http://a..org/é", "http://é.com/fr/", "http://u@h.com:80/de/x", "http://example.org?/es/", "HTTP://EXAMPLE.org/es/#", "http://a.com/FR/"]
    rules = registry.URL_RULES + [("h.com:80", "/de/", "allow"), ("org", "/", "block"), ("b.c.example.org", "/", "block"), (None, "/", "block"), ("", "", "allow")]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls * 2)], "page_id long, url string").withColumn("host", F.lit("h"))
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(x) for x in url_rules.judge(pages, r).collect()), key=str)
    clean = [x for x in rules if x[0] is not None]
    assert got == sorted(((i // 2, *brute_url(u, clean)) for i, u in enumerate(urls * 2)), key=str)
    none = url_rules.judge(pages, r.limit(0)).collect()
    assert len(none) == 2 * len(urls) and {x.verdict for x in none} == {"allow"}
    assert url_rules.judge(pages.limit(0), r).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from tests.llm.test_scores import brute_quality
    docs = documents(spark, SF_ORACLE)
    rows = {r.doc_id: r for r in docs.collect()}
    q = P.stage(P.quality(spark, docs, SF_ORACLE), "t1")
    assert q.columns == docs.columns
    kept = {r.doc_id: r.text for r in q.collect()}
    judged = brute_quality([(r.doc_id, r.text, r.source) for r in rows.values()])
    assert set(kept) == {i for i, w in judged.items() if w[-1]}
    d = P.stage(P.near_duplicates(spark, q, SF_ORACLE), "t2")
    prints = {i: brute_print(t) for i, t in kept.items()}
    assert sorted(r.doc_id for r in d.collect()) == sorted(set(brute_components(prints).values()))
    c = P.stage(P.decontamination(spark, d, SF_ORACLE), "t3")
    leaks = {r.doc_id for r in cgk_decontam.matches(d, read_table(spark, SF_ORACLE, "benchmark")).collect()}
    assert leaks and {r.doc_id for r in c.collect()} == {r.doc_id for r in d.collect()} - leaks
    p = P.stage(P.pii(spark, c, SF_ORACLE), "t4")
    assert p.columns == docs.columns
    for r in p.collect():
        assert r.n_chars == len(r.text) and not brute_spans(r.text)
    t = P.tokens(spark, p, SF_ORACLE)
    assert {r.doc_id: r.decoded_sha256 for r in t.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in p.collect()}
    assert {r.doc_id for r in P.run(spark, SF_ORACLE).collect()} == {r.doc_id for r in p.collect()}


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline as P
    docs = documents(spark, SF_SMALL).limit(0)
    for _, f in P.STAGES[:-1]:
        docs = P.stage(f(spark, docs, SF_SMALL), "e")
    assert P.tokens(spark, docs, SF_SMALL).count() == 0


# ------------------------------------------- names that clash, foreign folders

CLASHING = ["_id", "_key", "_host", "_gone", "gone", "row", "id", "key", "host", "doc", "text_key", "nth", "_text_key", "_nth", "_base", "_spans", "_terms", "_t", "_low",
            "_pattern", "_hits", "_own_key", "_sorted", "_reach", "_first", "_apart", "_chunks", "_found", "item_id", "root", "node", "fp", "lines", "a.b"]


def test_stages_keep_clashing_columns(spark, make):
    """Every internal name as a caller's column: kept, unchanged, wherever the row is kept."""
    texts = [prose(80, k) + f"\nsee mail{k}@example.org now\n" + "same line here for all\n" for k in range(14)] + [prose(80, 3) + " tail"]
    plain = make(texts)
    wide = plain
    for k, name in enumerate(CLASHING):
        wide = wide.withColumn(name, F.concat(F.lit(f"v{k}-"), F.col("doc_id").cast("string")))
    bench = spark.createDataFrame([(1, prose(80, 5))], "item_id long, text string")
    stages = [line_quality.clean, simhash_cover.deduplicate, lambda d: cgk_decontam.decontaminate(d, bench), pii_disclosure.sanitise]
    for stage_of in stages:
        want = {r.doc_id: r.text for r in stage_of(plain).collect()}
        out = stage_of(wide)
        assert out.columns == wide.columns
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r[name] == f"v{k}-{r.doc_id}" for r in rows for k, name in enumerate(CLASHING))


def test_tasks_need_no_install():
    """The models that are shipped to tasks travel by value."""
    import subprocess
    import sys

    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = subprocess.run([sys.executable, "-c", (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import base64\n"
        "from pyspark import cloudpickle\n"
        "from vigilspark.llm.cgk_decontam import Index\n"
        "from vigilspark.llm.ordinal_toxicity import Model\n"
        "print(base64.b64encode(cloudpickle.dumps((Index([(1, ['a', 'b', 'c', 'd'])]), Model()))).decode())")],
        capture_output=True, text=True, check=True, cwd="/")
    read = subprocess.run([sys.executable, "-c", (
        "import base64, pickle, sys\n"
        "ix, model = pickle.loads(base64.b64decode(sys.stdin.read()))\n"
        "assert 'vigilspark' not in sys.modules and len(ix.items) == 1\n"
        "print(type(model).__name__)")], input=made.stdout, capture_output=True, text=True, cwd="/")
    assert read.stdout.strip() == "Model", read.stderr


def test_op3_blocks_of_items(spark, make, monkeypatch):
    """A benchmark of several blocks finds what one block finds."""
    items = [prose(20 + k, 300 + k) for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([prose(40, 600 + k) + " " + items[k % 12] + " " + prose(30, 700 + k) for k in range(24)])
    want = sorted(tuple(r) for r in cgk_decontam.matches(docs, bench).collect())
    monkeypatch.setattr(cgk_decontam, "BLOCK_BYTES", sum(len(t) for t in items) // 3)
    assert len(list(cgk_decontam.blocks(bench))) >= 3
    got = sorted(tuple(r) for r in cgk_decontam.matches(docs, bench).collect())
    assert got == want and len({(r[0], r[2]) for r in got}) >= 24
