"""Property test: the native redaction folds equal a plain-Python model of the
semantics on random texts with random (overlapping) spans."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilspark.functions import rules
from vigilspark.functions.spans import SPANS_TYPE, redact, redact_merged

TYPES = ["email", "phone", "url", "password", "PERSON", "DATE"]


def model_faithful(text, spans):
    """Replace each span at its original offsets, right to left (stable on ties)."""
    out = text
    for s in sorted(spans, key=lambda x: x[2], reverse=True):
        tpl = rules.REDACTION_TEMPLATES.get(s[1], rules.DEFAULT_TEMPLATE)
        out = out[:s[2]] + tpl + out[s[3]:]
    return out


def model_merged(text, spans):
    """Union overlapping spans (sorted by start, widest first; first type wins)."""
    merged = []
    for s in sorted(spans, key=lambda x: (x[2], -x[3])):
        if merged and s[2] < merged[-1][3]:
            last = merged[-1]
            merged[-1] = (None, last[1], last[2], max(last[3], s[3]))
        else:
            merged.append((None, s[1], s[2], s[3]))
    return model_faithful(text, merged)


@st.composite
def cases(draw):
    text = draw(st.text(alphabet="ab é😀-", min_size=0, max_size=30))
    n = len(text)
    spans = []
    for _ in range(draw(st.integers(0, 5))):
        a = draw(st.integers(0, n))
        b = draw(st.integers(a, n))
        if b > a:
            spans.append((text[a:b], draw(st.sampled_from(TYPES)), a, b))
    return text, spans


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cases(), min_size=150, max_size=150))
def test_redaction_folds_match_model(spark, batch):
    rows = [(i, t, [{"text": s[0], "type": s[1], "start": s[2], "end": s[3]} for s in sp])
            for i, (t, sp) in enumerate(batch)]
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPANS_TYPE.simpleString()}")
    got = {r["id"]: (r["f"], r["m"]) for r in
           df.select("id", redact(F.col("text"), F.col("spans")).alias("f"),
                     redact_merged(F.col("text"), F.col("spans")).alias("m")).collect()}
    for i, (t, sp) in enumerate(batch):
        assert got[i][0] == model_faithful(t, sp), (t, sp)
        assert got[i][1] == model_merged(t, sp), (t, sp)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cases(), min_size=150, max_size=150))
def test_stitch_path_equals_fold_without_overlaps(spark, batch):
    from vigilspark.functions.spans import _stitch, template_for
    rows = []
    for i, (t, sp) in enumerate(batch):
        keep, end = [], -1
        for x in sorted(sp, key=lambda x: x[2]):
            if x[2] >= end:
                keep.append(x)
                end = x[3]
        rows.append((i, t, [{"text": x[0], "type": x[1], "start": x[2], "end": x[3]} for x in keep]))
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPANS_TYPE.simpleString()}")
    asc = F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                         template_for(s["type"]).alias("tpl")))
    got = {r["id"]: r["x"] for r in df.select("id", _stitch(F.col("text"), asc).alias("x")).collect()}
    for i, t, sp in rows:
        assert got[i] == model_faithful(t, [(x["text"], x["type"], x["start"], x["end"]) for x in sp]), t


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cases(), min_size=150, max_size=150))
def test_chunked_stitch_crosses_chunk_boundaries(spark, batch):
    import vigilspark.functions.spans as S
    rows = []
    for i, (t, sp) in enumerate(batch):
        keep, end = [], -1
        for x in sorted(sp, key=lambda x: x[2]):
            if x[2] >= end:
                keep.append(x)
                end = x[3]
        rows.append((i, t, [{"text": x[0], "type": x[1], "start": x[2], "end": x[3]} for x in keep]))
    old = S.TEXT_CHUNK
    S.TEXT_CHUNK = 3  # tiny chunks: most pieces span several
    try:
        df = spark.createDataFrame(rows, f"id int, text string, spans {SPANS_TYPE.simpleString()}")
        df = df.withColumn("ch", S.text_chunks(F.col("text"))).withColumn("ord", S.sorted_for_redaction(F.col("spans")))
        out = df.select("id", S.redact_sorted(F.col("text"), F.col("ord"), F.col("ch")).alias("x"))
        got = {r["id"]: r["x"] for r in out.collect()}
    finally:
        S.TEXT_CHUNK = old
    for i, t, sp in rows:
        assert got[i] == model_faithful(t, [(x["text"], x["type"], x["start"], x["end"]) for x in sp]), t


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cases(), min_size=150, max_size=150))
def test_staged_merge_matches_model(spark, batch):
    import vigilspark.functions.spans as S
    rows = [(i, t, [{"text": s[0], "type": s[1], "start": s[2], "end": s[3]} for s in sp]) for i, (t, sp) in enumerate(batch)]
    df = spark.createDataFrame(rows + [(-1, "x", None)], f"id int, text string, spans {SPANS_TYPE.simpleString()}")
    whole, S.PREFIX_CHUNK = S.PREFIX_CHUNK, 2  # unions cross the chunks of the running maximum
    try:
        out = S.add_merged_spans(df, "spans", "m")
        assert out.columns == ["id", "text", "spans", "m"]
        got = {r["id"]: (r["m"], r["x"]) for r in out.withColumn("x", redact(F.col("text"), F.col("m"))).collect()}
    finally:
        S.PREFIX_CHUNK = whole
    assert got[-1][0] is None
    for i, (t, sp) in enumerate(batch):
        assert got[i][1] == model_merged(t, sp), (t, sp)
        assert all(a["end"] <= b["start"] for a, b in zip(got[i][0], got[i][0][1:]))


def test_merge_of_many_overlapping_spans(spark):
    import time
    import vigilspark.functions.spans as S
    n = 60_000  # one chain of overlaps, then a gap
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.lit(None).cast("string").alias("text"), F.lit("url").alias("type"), (i * 3).cast("int").alias("start"), (i * 3 + 5).cast("int").alias("end"))).alias("spans"))
    extra = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit("ssn").alias("type"), F.lit(n * 4).alias("start"), F.lit(n * 4 + 2).alias("end")))
    t0 = time.time()
    m = S.add_merged_spans(df.withColumn("spans", F.concat(extra, "spans")), "spans", "m").first()["m"]
    assert [(s["type"], s["start"], s["end"]) for s in m] == [("url", 0, (n - 1) * 3 + 5), ("ssn", n * 4, n * 4 + 2)]
    assert time.time() - t0 < 60


def test_span_that_ends_a_text_of_whole_chunks(spark):
    import vigilspark.functions.spans as S
    from vigilspark.operators.outbound import outbound_scan
    mail = "ada@example.org"
    rows = [(k, "x " * ((k * S.TEXT_CHUNK - len(mail) - 1) // 2) + "y" * ((k * S.TEXT_CHUNK - len(mail) - 1) % 2) + " " + mail) for k in (1, 2, 3)]
    assert all(len(t) == k * S.TEXT_CHUNK for k, t in rows)
    df = spark.createDataFrame(rows + [(4, rows[0][1] + " end"), (5, None), (6, "")], "id int, text string")
    tag = rules.REDACTION_TEMPLATES["email"]
    for merged in (False, True):
        got = {r["id"]: r["final_text"] for r in outbound_scan(df, "text", merge_overlaps=merged).collect()}
        assert got == {k: t.replace(mail, tag) for k, t in rows} | {4: rows[0][1].replace(mail, tag) + " end", 5: None, 6: ""}


def test_pii_pipeline_redacts_a_span_at_the_end_of_whole_chunks(spark):
    from vigilspark.functions.spans import TEXT_CHUNK
    from vigilspark.llm.pii_disclosure import sanitise
    mail = "ada@example.org"
    text = "7 " * ((3 * TEXT_CHUNK - len(mail)) // 2) + "8" * ((3 * TEXT_CHUNK - len(mail)) % 2 - 1) + mail
    text = " " * (3 * TEXT_CHUNK - len(text)) + text
    assert len(text) == 3 * TEXT_CHUNK
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert got == {1: text.replace(mail, "[EMAIL]"), 2: "none"}
