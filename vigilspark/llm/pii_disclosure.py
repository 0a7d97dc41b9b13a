"""PII: information-theoretic sanitisation, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by pattern.  Their values are the
protected entities.  Corpus co-occurrence then tells how strongly other terms
reveal them: with n(e, t) the distinct texts that hold term t in a context of
entity e, n(e) the distinct texts with e, n(t) those with t, and D all distinct
texts,

    PMI(e, t) = log2(n(e, t) D / (n(e) n(t))),   disclosure = PMI / IC(e),   IC(e) = log2(D / n(e))

is the share of the entity's information that the term gives away.  Terms with
a disclosure of ``REMOVE`` or more are removed, of ``GENERALISE`` or more
generalised, wherever they occur, where the counts show it: the disclosure is h
or more just when p = n(e, t) / n(t), the share of the term's texts that have it
by the entity, is q = (n(e) / D)^(1 - h) or more, and by Chernoff's bound a term
whose true share is below q gives such counts with a probability of at most
exp(-n(t) KL(p, q)), which has to be ``DOUBT`` or less.  No count of texts is
asked for: of terms that stand by one entity only, one text is enough to
generalise from D = 10,000 on, two from 200, three from 65.  A context is the
``WINDOW`` characters on both sides of an occurrence; equal texts (copies) count
once, so copies alone prove nothing, and however often a text repeats an entity
it is one.  A term is a run of letters, A-Z lower-cased, whole inside the
context.

All texts are counted.  One pass over the words of the corpus marks, per term,
which of ``64 * LANES`` hash cells its texts fall into; the marked cells bound
n(t) from below, and so the disclosure from above.  Only terms that can still
reach the thresholds are joined to the words and counted exactly, so frequent
words near entities make no rows and no term over the thresholds is lost.

Defined cases: null and empty texts have no spans; repeated rows give a row
each and count once; terms that overlap a base span are left to it; overlapping
spans are redacted as one, with the first's mark; other columns are ignored
(``sanitise`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import add_pattern_spans, text_chunks
from ..functions.spans import _stitch as stitch
from .common import ascii_lower, carried, stage, text_key, unpacked

KINDS = ["email", "ip", "card", "phone"]
WINDOW, MIN_LETTERS = 80, 3
REMOVE, GENERALISE, DOUBT = 0.9, 0.75, 0.1
LANES = 16  # longs of hash cells a term
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "generalised": "[TERM]"}

# Anchored where a run begins (or the last match ended) and possessive, so that
# long runs are read once; they match what the plain patterns match.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = [
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(s: Column) -> Column:
    digits = _digits(s["text"])
    n = F.length(digits)
    short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = F.forall(F.split(s["text"], r"\."), lambda p: (F.length(short(p)) <= 3) & (F.lpad(short(p), 3, "0") <= "255"))
    return (F.when(s["type"] == "ip", small)
            .when(s["type"] == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
            .when(s["type"] == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "_base") -> DataFrame:
    """Adds ``out``: valid spans (text, type, start, end) by kind, then start."""
    found = add_pattern_spans(docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))), "_t", PATTERNS, "_found")
    return found.withColumn(out, F.filter("_found", _valid)).drop("_t", "_found")


def _contexts(spotted: DataFrame) -> DataFrame:
    """(entity, key, terms) of the contexts of each entity in each text."""
    # explode_outer: a plain explode or filter would evaluate the patterns again below it
    e = spotted.select("key", "text", F.explode_outer("_base").alias("s")).where(F.col("s").isNotNull())
    value = F.when(F.col("s.type") == "email", ascii_lower(F.col("s.text"))).when(F.col("s.type") == "ip", F.col("s.text")).otherwise(_digits(F.col("s.text")))
    start = F.greatest(F.col("s.start") - WINDOW, F.lit(0))
    before = F.substr("text", start + 1, F.col("s.start") - start)
    before = F.when(start > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)  # cut words are no terms
    before = F.when(F.col("s.text").rlike(r"^\p{L}"), F.regexp_replace(before, r"\p{L}+$", "")).otherwise(before)
    after = F.substr("text", F.col("s.end") + 1, F.lit(WINDOW))
    after = F.when(F.col("s.end") + WINDOW < F.length("text"), F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    after = F.when(F.col("s.text").rlike(r"\p{L}$"), F.regexp_replace(after, r"^\p{L}+", "")).otherwise(after)
    context = ascii_lower(F.concat(before, F.lit("\n"), after))
    return e.select(F.concat("s.type", F.lit(":"), value).alias("entity"), "key", F.array_distinct(F.split(context, r"[^\p{L}]+")).alias("terms")).distinct()


def _over(n_t: Column, total: int, least: float) -> Column:
    """Whether n(e, t), n(e) and ``n_t`` texts among ``total`` show a disclosure
    of ``least`` or more; more texts ``n_t`` never make it true."""
    p, q = F.col("n_et") / n_t, F.pow(F.col("n_e") / F.lit(total), F.lit(1 - least))
    apart = F.when(n_t > F.col("n_et"), (n_t - F.col("n_et")) * F.log((1 - p) / (1 - q))).otherwise(F.lit(0.0))
    return (p >= q) & (F.col("n_et") * F.log(p / q) + apart >= -math.log(DOUBT) - 1e-9)


def _at_least(words: DataFrame) -> DataFrame:
    """(term, at_least): hash cells that the term's texts fall into, at most n(t)."""
    cell = F.pmod(F.xxhash64("key"), F.lit(64 * LANES))
    marks = words.select("term", cell.alias("cell")).select("term", (F.col("cell") % LANES).alias("lane"), F.expr(f"shiftleft(1L, cast(cell div {LANES} as int))").alias("mark"))
    lanes = marks.groupBy("term").agg(*[F.bit_or(F.when(F.col("lane") == i, F.col("mark")).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(LANES)])
    return lanes.select("term", sum(F.bit_count(F.col(f"b{i}")) for i in range(LANES)).alias("at_least"))


def disclosing_terms(spotted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, level) of terms over the thresholds, level 'removed' or
    'generalised', and (key, term) of the texts that hold candidates.
    ``spotted``: text, key, _base."""
    contexts = stage(_contexts(spotted), "contexts")
    n_e = contexts.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    total = spotted.select(F.count_distinct("key")).first()[0]
    near = contexts.select("entity", "key", F.explode("terms").alias("term")).where(F.length("term") >= MIN_LETTERS).distinct()
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_et")).join(n_e, "entity").where((F.col("n_e") < total) & _over(F.col("n_et"), total, GENERALISE))
    pairs = pairs.select("term", "n_et", "n_e").distinct()  # a common word stands by many entities, with few different counts
    words = spotted.select("key", F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), r"[^\p{L}]+"))).alias("term")).where(F.length("term") >= MIN_LETTERS)
    least = F.greatest("at_least", "n_et")
    pairs = stage(pairs.join(_at_least(words), "term").where(_over(least, total, GENERALISE)).drop("at_least"), "pairs")
    held = stage(words.join(pairs.select("term").distinct(), "term", "left_semi").distinct(), "held")
    n_t = held.groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term").where(_over(F.col("n_t"), total, GENERALISE))
    removed = told.groupBy("term").agg(F.max(_over(F.col("n_t"), total, REMOVE)).alias("removed"))
    return removed.select("term", F.when(F.col("removed"), "removed").otherwise("generalised").alias("level")), held


def _of_kind(spans, kind: str) -> Column:
    return F.filter(spans, lambda s: s["type"] == kind)


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base spans, then disclosing terms); columns of
    those names and of other names that begin with an underscore belong to this function."""
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    spotted = base_spans(docs.select(text.alias("text"), text_key(F.col(text_col)).alias("key")))
    terms, held = disclosing_terms(spotted)
    flagged = stage(held.join(terms, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "level"))).alias("_terms")).withColumnRenamed("key", "_key"), "flagged")
    d = base_spans(docs.withColumn("_own_key", text_key(F.col(text_col))), text_col, "_base")
    d = d.join(flagged, d["_own_key"] == flagged["_key"], "left")
    alternatives = F.array_join(F.transform("_terms", lambda t: t["term"]), "|")
    pattern = F.when(F.col("_terms").isNotNull(), F.concat(F.lit(r"(?<!\p{L})(?:"), alternatives, F.lit(r")(?!\p{L})"))).otherwise(F.lit(r"(?!)"))
    d = d.withColumn("_low", F.when(F.col("_terms").isNotNull(), ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).otherwise(F.lit(""))).withColumn("_pattern", pattern)
    d = add_pattern_spans(d, "_low", [("term", F.col("_pattern"))], "_hits")
    level = F.map_from_entries(F.col("_terms"))
    hits = F.transform(F.filter("_hits", lambda s: ~_overlaps(s, F.col("_base"))),
                       lambda s: F.struct(s["text"].alias("text"), F.try_element_at(level, s["text"]).alias("type"), s["start"].alias("start"), s["end"].alias("end")))
    by_kind = F.concat(_of_kind(hits, "removed"), _of_kind(hits, "generalised"))
    spans = F.when(F.size("_hits") > 0, F.concat("_base", by_kind)).otherwise(F.col("_base"))
    return d.withColumn("_spans", spans).select(*[d[c] for c in names], "_base", "_spans")


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["type"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    d = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n = lambda k: F.size(_of_kind("_base", k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redacted(text: Column, ordered: Column, chunks: Column) -> Column:
    """``text`` with ``ordered`` (start, end, tpl; sorted, apart) replaced."""
    return F.when(F.size(ordered) > 0, stitch(text, ordered, chunks)).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind's mark."""
    d = find(carried(docs, text_col))
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    spans = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), mark[s["type"]].alias("tpl"))))
    d = d.withColumn("_sorted", spans)
    # a span that begins inside what precedes it widens that one
    reach = F.transform(F.col("_sorted"), lambda s, i: F.array_max(F.transform(F.slice("_sorted", 1, i + 1), lambda x: x["end"])))
    d = d.withColumn("_reach", F.when(F.size("_sorted") > 0, reach).otherwise(F.array().cast("array<int>")))
    first = F.transform("_sorted", lambda s, i: F.struct(s["start"].alias("start"), s["tpl"].alias("tpl"), i.alias("i"), ((i == 0) | (s["start"] >= F.coalesce(F.try_element_at("_reach", i), F.lit(0)))).alias("new")))
    d = d.withColumn("_first", F.filter(first, lambda s: s["new"]))
    ends = F.transform("_first", lambda s, k: F.struct(s["start"].alias("start"), F.element_at("_reach", F.coalesce(F.try_element_at("_first", k + 2)["i"], F.size("_reach"))).alias("end"), s["tpl"].alias("tpl")))
    d = d.withColumn("_apart", ends).withColumn("_chunks", F.when(F.size("_apart") > 0, text_chunks(F.col("text"))))
    return unpacked(d.select("row", redacted(F.col("text"), F.col("_apart"), F.col("_chunks")).alias("text")), docs, text_col)
