"""Positioned findings ("spans") and redaction, as native Column expressions.

A span is ``STRUCT<text STRING, type STRING, start INT, end INT>`` with code-point
offsets, end exclusive.  Offsets are derived without a UDF: with
``m = regexp_extract_all(t, p, 0)`` (the matches) and ``g = split(t, p, -1)``
(the gaps between them), match *i* starts at ``len(g[0..i]) + len(m[0..i-1])``.
This holds because no pattern can match the empty string, so matches and gaps
alternate exactly.  Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

SPAN_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
SPANS_TYPE = T.ArrayType(SPAN_TYPE)


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


# A literal that every match of the (case-sensitive) pattern contains; rows
# without it cannot match, so the regex is skipped for them (a plain substring
# test is far cheaper than a regex scan).
REQUIRED_LITERAL = {
    "email": "@",
    "url": "http",
    "aws_key": "AKIA",
    "github_token": "_",
    "private_key": "-----BEGIN",
}


def add_pattern_spans(df: DataFrame, text_col: str, patterns, out_col: str) -> DataFrame:
    """Adds ``out_col`` = spans of several ``(type, java_pattern)`` in declared
    order.  Three projections: all match arrays (one regex pass per pattern),
    then the gap arrays only for rows that matched (second pass), then the
    spans.  Each staged column is referenced more than once downstream, so
    Catalyst keeps the stages instead of inlining the regexes into lambdas."""
    t = F.col(text_col)
    tag = out_col.replace(".", "_")
    m_cols = [f"__m{i}_{tag}" for i in range(len(patterns))]
    g_cols = [f"__g{i}_{tag}" for i in range(len(patterns))]
    def matches(name, p):
        m = F.regexp_extract_all(t, F.lit(p) if isinstance(p, str) else p, 0)
        lit = REQUIRED_LITERAL.get(name)
        # exact gate: the literal occurs in every match of the pattern
        return m if lit is None else F.when(t.contains(lit), m).otherwise(F.array().cast("array<string>"))

    df = df.select("*", *[matches(n, p).alias(m) for (n, p), m in zip(patterns, m_cols)])
    df = df.select("*", *[F.when(F.size(F.col(m)) > 0, F.split(t, F.lit(p) if isinstance(p, str) else p, -1)).alias(g)
                          for (_, p), m, g in zip(patterns, m_cols, g_cols)])
    # Most rows match nothing: they skip the offset machinery entirely.
    any_match = F.greatest(*[F.size(F.col(m)) for m in m_cols], F.lit(0)) > 0
    df = df.withColumn(f"__lens_{tag}", F.when(any_match, F.array(*[_segment_lengths(F.col(m), F.col(g))
                                                                   for m, g in zip(m_cols, g_cols)])))
    df, ends_col = _add_chunked_ends(df, f"__lens_{tag}", tag)
    ends = [F.element_at(F.col(ends_col), i + 1) for i in range(len(patterns))]
    parts = [_spans_at(F.col(m), e, name) for (name, _), m, e in zip(patterns, m_cols, ends)]
    spans = F.concat(*parts) if len(parts) > 1 else parts[0]
    df = df.withColumn(out_col, F.when(F.col(f"__lens_{tag}").isNull(), empty_spans()).otherwise(spans))
    return df.drop(*m_cols, *g_cols, f"__lens_{tag}", ends_col)


# --- prefix sums of segment lengths -------------------------------------------
# Match i of a pattern ends where the running sum of (gap_j + match_j) lengths,
# j <= i, ends.  Spark arrays are immutable, so a single fold that appends to
# its accumulator copies it every step (O(m^2) for m matches).  The sums are
# therefore taken in chunks: each chunk of PREFIX_CHUNK segments is folded on
# its own, chunk totals are folded into chunk offsets, and offsets are added
# back -- O(m * PREFIX_CHUNK + (m / PREFIX_CHUNK)^2) element copies, all native.

PREFIX_CHUNK = 128


def _segment_lengths(matches: Column, gaps: Column) -> Column:
    lens = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))), matches,
                      lambda g, m: F.length(g) + F.length(m))
    return F.when(gaps.isNull(), F.array().cast("array<int>")).otherwise(lens)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _inclusive_fold(arr: Column, combine=_add) -> Column:
    return F.aggregate(arr, F.array().cast("array<int>"), lambda acc, x: F.concat(
        acc, F.array(combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))


def _add_chunked_ends(df: DataFrame, lens_col: str, tag: str, combine=_add):
    """``lens_col``: array (one per pattern) of arrays of segment lengths.
    Adds the matching array of arrays of running end offsets; with
    ``combine=F.greatest``, of running maxima (of values from 0 on)."""
    loc, off, ends = f"__loc_{tag}", f"__off_{tag}", f"__ends_{tag}"
    C = PREFIX_CHUNK

    def local(lens):
        n_chunks = F.ceil(F.size(lens) / F.lit(C)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))),
                             lambda k: _inclusive_fold(F.slice(lens, k * C + 1, C), combine))
        return F.when(F.size(lens) == 0, F.array().cast("array<array<int>>")).otherwise(chunks)

    def exclusive_offsets(chunks):
        incl = _inclusive_fold(F.transform(chunks, lambda ch: F.element_at(ch, -1)), combine)
        return F.when(F.size(chunks) <= 1, F.array_repeat(F.lit(0), F.size(chunks))).otherwise(
            F.concat(F.array(F.lit(0)), F.slice(incl, 1, F.size(chunks) - 1)))

    df = df.withColumn(loc, F.transform(F.col(lens_col), local))
    df = df.withColumn(off, F.transform(F.col(loc), exclusive_offsets))
    shifted = F.zip_with(F.col(loc), F.col(off), lambda chunks, offs: F.flatten(F.zip_with(
        chunks, offs, lambda ch, o: F.transform(ch, lambda x: combine(x, o)))))
    df = df.withColumn(ends, shifted)
    return df.drop(loc, off), ends


def _spans_at(matches: Column, ends: Column, type_name) -> Column:
    type_of = (lambda m: F.lit(type_name)) if isinstance(type_name, str) else type_name
    spans = F.zip_with(matches, ends, lambda m, e: F.struct(
        m.alias("text"), type_of(m).alias("type"), (e - F.length(m)).alias("start"), e.alias("end")))
    return F.when(F.size(ends) == 0, empty_spans()).otherwise(spans)


def pii_patterns():
    """Email, phone, ssn, credit_card, ip_address, url (case-sensitive)."""
    return [(n, rules.java_regex(p, False)) for n, p in rules.PII_PATTERNS]


def secret_patterns():
    """api_key, bearer_token, aws_key, github_token, password, private_key."""
    return [(n, rules.java_regex(p, ic)) for n, p, ic in rules.SECRET_PATTERNS]


def add_pii_spans(df: DataFrame, text_col: str, out_col: str = "pii_spans") -> DataFrame:
    return add_pattern_spans(df, text_col, pii_patterns(), out_col)


def add_secret_spans(df: DataFrame, text_col: str, out_col: str = "secret_spans") -> DataFrame:
    return add_pattern_spans(df, text_col, secret_patterns(), out_col)


def template_for(type_col: Column) -> Column:
    tmap = F.create_map(*[x for k, v in rules.REDACTION_TEMPLATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(tmap, type_col), F.lit(rules.DEFAULT_TEMPLATE))


def _splice(acc: Column, s: Column) -> Column:
    return F.concat(F.substr(acc, F.lit(1), s["start"]), s["tpl"], F.substr(acc, s["end"] + 1))


TEXT_CHUNK = 256
SHORT_TEXT = 512  # code points: texts up to here need no chunks


def text_chunks(text: Column) -> Column:
    """The text as consecutive pieces of TEXT_CHUNK code points (one regex
    pass).  Stage it as a column: string elements of a row's array are read
    without copying, while ``substring`` on a long string has to count
    characters from its start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_CHUNK), 0)


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of the text held in ``chunks`` (0-based)."""
    C = TEXT_CHUNK
    ka, oa = F.floor(a / C).cast("int"), (a % C).cast("int")
    kb, ob = F.floor((b - 1) / C).cast("int"), ((b - 1) % C).cast("int")
    same = F.substr(F.element_at(chunks, ka + 1), oa + 1, b - a)
    spread = F.concat(F.substr(F.element_at(chunks, ka + 1), oa + 1),
                      F.array_join(F.slice(chunks, ka + 2, F.greatest(kb - ka - 1, F.lit(0))), ""),
                      F.substr(F.element_at(chunks, kb + 1), F.lit(1), ob + 1))
    return F.when(a >= b, F.lit("")).when(ka == kb, same).otherwise(spread)


def _stitch(text: Column, asc: Column, chunks: Column | None = None) -> Column:
    """Non-overlapping spans sorted by start: text between spans + templates,
    joined once.  With the staged ``text_chunks`` each piece costs at most
    two chunk cuts, so the build is O(length + spans * TEXT_CHUNK); a plain
    character substring would scan from the start of the text per piece."""
    ends = F.concat(F.array(F.lit(0)), F.transform(asc, lambda s: s["end"]))
    last = F.element_at(ends, -1)
    prev_end = F.slice(ends, 1, F.size(asc))  # as many as spans: zip_with would pair the last with a null span
    if chunks is None:
        pieces = F.zip_with(asc, prev_end, lambda s, pe: F.concat(
            F.substr(text, pe + 1, s["start"] - pe), s["tpl"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, last + 1))
    pieces = F.zip_with(asc, prev_end, lambda s, pe: F.concat(_piece(chunks, pe, s["start"]), s["tpl"]))
    return F.concat(F.array_join(pieces, ""), _piece(chunks, last, F.length(text)))


def sorted_for_redaction(spans: Column) -> Column:
    """Spans with their templates, stably sorted by start descending."""
    return F.array_sort(F.transform(spans, lambda s, i: F.struct(
        (-s["start"]).alias("k"), i.alias("o"), s["start"].alias("start"),
        s["end"].alias("end"), template_for(s["type"]).alias("tpl"))))


def redact_sorted(text: Column, ordered: Column, chunks: Column | None = None) -> Column:
    """Redaction from ``sorted_for_redaction`` output (pass staged columns so
    the sort and the chunking run once per row).  Rows whose ``chunks`` are null
    are cut from the text itself, which costs less where it is short."""
    asc = F.reverse(ordered)  # starts ascending (non-overlapping spans have distinct starts)
    overlapping = F.exists(F.zip_with(F.slice(asc, 2, F.greatest(F.size(asc), F.lit(1))), asc,
                                      lambda nxt, cur: nxt["start"] < cur["end"]),
                           lambda x: F.coalesce(x, F.lit(False)))  # zip_with pads with NULL
    return (F.when(F.size(ordered) == 0, text)
            .when(~overlapping, _stitch(text, asc) if chunks is None else
                  F.when(chunks.isNull(), _stitch(text, asc)).otherwise(_stitch(text, asc, chunks)))
            .otherwise(F.aggregate(ordered, text, _splice)))


def redact(text: Column, spans: Column) -> Column:
    """D4, faithful: stable sort by start descending, then replace each span at
    its *original* offsets, one after the other.  Overlapping spans therefore
    cut into text that was already replaced, exactly like the reference.

    That fold copies the text once per span.  When no spans overlap (the usual
    case) its result equals stitching the gaps and templates in one pass, so
    the fold only runs for rows that really overlap."""
    return redact_sorted(text, sorted_for_redaction(spans))


def merge_overlaps(spans: Column) -> Column:
    """D5 helper: union overlapping spans.  Sorted by start, widest first; an
    overlapping span extends the current one, whose type (the first/widest) wins."""
    keyed = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), i.alias("o"),
        s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text")))
    ordered = F.array_sort(keyed)
    init = F.array().cast(T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("type", T.StringType())])))

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        extend = F.size(acc) > 0
        overlaps = extend & (s["start"] < last["end"])
        merged_last = F.struct(last["start"].alias("start"),
                               F.greatest(last["end"], s["end"]).alias("end"),
                               last["type"].alias("type"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged_last))) \
            .otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(ordered, init, step)


def redact_merged(text: Column, spans: Column) -> Column:
    """Redact the union of overlapping spans (explicit extra, not default)."""
    merged = merge_overlaps(spans)
    as_spans = F.transform(merged, lambda s: F.struct(
        F.lit(None).cast("string").alias("text"), s["type"].alias("type"),
        s["start"].alias("start"), s["end"].alias("end")))
    return redact(text, as_spans)


def add_merged_spans(df: DataFrame, spans_col: str, out_col: str) -> DataFrame:
    """D5, staged: adds ``out_col`` = the unions of overlapping spans, as spans
    (text null, the type of the first, widest one).  A sweep over the spans by
    start: one begins a new union where its start is at or behind the running
    maximum of the ends before it.  The maxima are taken in chunks, so the cost
    grows with the number of spans; null spans give null."""
    tag = out_col.replace(".", "_")
    by_start, top, heads = f"__by_{tag}", f"__top_{tag}", f"__heads_{tag}"
    keyed = F.transform(F.col(spans_col), lambda s, i: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), i.alias("o"), s["end"].alias("end"), s["type"].alias("type")))
    df = df.withColumn(by_start, F.array_sort(keyed))
    df = df.withColumn(top, F.array(F.transform(F.col(by_start), lambda s: s["end"])))
    df, ends_col = _add_chunked_ends(df, top, tag, F.greatest)
    df = df.withColumn(top, F.element_at(F.col(ends_col), 1)).drop(ends_col)
    spans, high, n = F.col(by_start), F.col(top), F.size(by_start)
    # positions (from 1) of the spans that begin a union
    begins = F.filter(F.transform(spans, lambda s, i: F.when(
        (i == 0) | (s["start"] >= F.try_element_at(high, F.greatest(i, F.lit(1)))), i + 1)), lambda i: i.isNotNull())
    df = df.withColumn(heads, begins)
    first = F.col(heads)
    unions = F.transform(first, lambda h, k: F.struct(
        F.lit(None).cast("string").alias("text"), F.element_at(spans, h)["type"].alias("type"),
        F.element_at(spans, h)["start"].alias("start"),
        F.element_at(high, F.coalesce(F.try_element_at(first, k + 2) - 1, n)).alias("end")))
    return df.withColumn(out_col, unions).drop(by_start, top, heads)


def preview(c: Column, n: int = 50) -> Column:
    """First n characters plus '...' when longer (finding preview, B7)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
