"""Named-entity spans from a gazetteer (D3, re-aimed) plus a model hook.

The reference runs a statistical NER model per response.  Here entities come
from a dictionary (entity text -> label) that may be as large as a table:

1. candidate phase: each text's distinct word n-grams (n up to the longest
   entry) pass a Bloom filter of the dictionary's keys (one bit array with a fixed
   number of bits a key, one broadcast row), and what is left is equi-joined
   with the dictionary, the n-grams of one key (or one frequent word that the
   filter lets through) spread over tasks by their texts.  The plan is the same for
   ten entries and for millions; only the filter is broadcast;
2. span phase: offsets of the hits in the staged token and gap arrays, from prefix
   sums where a text has many tokens; overlaps resolve leftmost-longest.  No Python runs per row.

``model_entity_spans`` is the pluggable hook: an Arrow-batched pandas UDF
running any callable ``text -> [(text, label, start, end)]`` once per batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import spans as S
from .joins import BLOOM_MOST_SHARED, filter_bits, pruned, salted_join
from .partitioning import explode_computed

TOKEN = r"(?U)[\w#]+"
SHORT_TOKENS = 128  # texts of at most so many tokens take offsets from their beginning, without prefix sums


def entity_dictionary(spark, sf_dir) -> DataFrame:
    """Gazetteer from the driver's tables: customer names (PERSON), supplier
    names (ORG), nations (GPE), regions (LOC)."""
    from ..sources.tables import read_table
    parts = [
        read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity"), F.lit("PERSON").alias("label")),
        read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("entity"), F.lit("ORG").alias("label")),
        read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.lit("GPE").alias("label")),
        read_table(spark, sf_dir, "region").select(F.col("r_name").alias("entity"), F.lit("LOC").alias("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("label").isin(rules.ENTITY_LABELS))


def _key(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), 0), " ")


def _text_key(text: Column) -> Column:
    """40 bits of the text's hash: it travels with every candidate, and texts that share it only share their label maps."""
    return F.shiftrightunsigned(F.xxhash64(text), 24)


def normalized_dictionary(dictionary: DataFrame) -> DataFrame:
    """(key, label): entries keyed by their token sequence; the first label
    (alphabetical) wins when one key has several."""
    d = dictionary.select("label", _key(F.col("entity")).alias("key")).where(F.col("key") != "")
    return d.groupBy("key").agg(F.min("label").alias("label"))


def gazetteer_spans(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame,
                    max_words: int | None = None, bits: int | None = None) -> DataFrame:
    """Adds ``entity_spans`` (array<span>) to ``df``.

    An entity matches a run of whole tokens (maximal ``[\\w#]`` runs) equal to
    its own tokens; overlapping matches resolve leftmost, then longest.
    Offsets come from the staged token/gap arrays (prefix sums), so no
    per-row pattern is compiled.

    ``max_words`` is the number of tokens of the longest entry and ``bits`` the size
    of the key filter; None measures them by one aggregate over the dictionary (they set
    how many n-gram sizes the plan has, and how many n-grams that are no entry reach its
    shuffle).  The labels of a text's n-grams return to it through a join on the
    text's hash: a label belongs to its n-gram, whatever text holds it, so rows
    without an id, repeated ids and equal texts are all right.  Null texts and an
    empty dictionary give no spans."""
    d = normalized_dictionary(dictionary)
    if not (max_words and bits):
        keys = dictionary.select(_key(F.col("entity")).alias("key")).where(F.col("key") != "")
        longest, n_keys = keys.agg(F.max(F.size(F.split("key", " "))), F.approx_count_distinct("key")).first()
        max_words, bits = max_words or longest, bits or filter_bits(n_keys, BLOOM_MOST_SHARED)
    if not max_words:
        return df.withColumn("entity_spans", S.empty_spans())
    max_n = max_words

    t = F.col(text_col)

    def ngram_levels(toks):
        # n-grams by shifting: gram_n[i] = gram_{n-1}[i] + ' ' + toks[i+n-1]
        # (zip_with pads the shorter side with NULL, and concat of NULL is NULL).
        levels = [toks]
        for n in range(2, max_n + 1):
            levels.append(F.zip_with(levels[-1], F.slice(toks, n, F.greatest(F.size(toks), F.lit(1))),
                                     lambda a, b: F.concat(a, F.lit(" "), b)))
        return levels

    def positioned(levels, label_of):
        def at_level(n):
            # two-argument lambda (element, index); n is bound by the closure
            return lambda g, i: F.when(F.array_contains(F.col("_keys"), g), F.struct((i + 1).alias("pos"), F.lit(n).alias("n"), label_of(g).alias("label")))

        per_level = [F.transform(lv, at_level(n)) for n, lv in enumerate(levels, start=1)]
        return F.array_compact(F.flatten(F.array(*per_level)))

    # candidates from a throw-away tokenization; only the text's label map travels back
    # to the rows (the token arrays are rebuilt after the join)
    tok = df.select(_text_key(t).alias("_tk"), F.regexp_extract_all(t, F.lit(TOKEN), 0).alias("_t"))
    grams = tok.select("_tk", explode_computed(F.array_distinct(F.flatten(F.array(*ngram_levels(F.col("_t"))))), "key"))
    per_text = salted_join(pruned(grams, d, bits), d, F.col("_tk")).groupBy("_tk").agg(F.map_from_entries(F.collect_set(F.struct("key", "label"))).alias("_labels"))
    per_text = per_text.withColumn("_keys", F.map_keys("_labels"))
    staged = df.withColumn("_tk", _text_key(t)).join(per_text, "_tk", "left").drop("_tk")
    staged = staged.withColumn("_toks", F.when(F.col("_labels").isNotNull(), F.regexp_extract_all(t, F.lit(TOKEN), 0)))
    staged = staged.withColumn("_hits", F.when(F.col("_labels").isNull(), F.array()).otherwise(
        positioned(ngram_levels(F.col("_toks")), lambda g: F.try_element_at(F.col("_labels"), g)))) \
        .drop("_labels", "_keys")

    # token end offsets: of the hits only in a short text, of all tokens (chunked prefix sums) in a long one
    has = F.size("_hits") > 0
    long = has & (F.size("_toks") > SHORT_TOKENS)
    staged = staged.withColumn("_gaps", F.when(has, F.split(t, TOKEN, -1)))
    staged = staged.withColumn("_lens", F.when(long, F.array(S._segment_lengths(F.col("_toks"), F.col("_gaps")))))
    staged, ends_col = S._add_chunked_ends(staged, "_lens", "ent")
    staged = staged.withColumn("_tend", F.element_at(F.col(ends_col), 1)) \
        .withColumn("_chunks", F.when(long, S.text_chunks(t))).drop("_lens", ends_col)
    toks, gaps, tend = F.col("_toks"), F.col("_gaps"), F.col("_tend")

    def end_of(k):
        near = F.length(F.array_join(F.slice(gaps, 1, k), "")) + F.length(F.array_join(F.slice(toks, 1, k), ""))
        return F.when(tend.isNull(), near).otherwise(F.element_at(tend, k))

    def to_span(h):
        i, n = h["pos"], h["n"]
        start = end_of(i) - F.length(F.element_at(toks, i))
        end = end_of(i + n - 1)
        return F.struct(start.alias("start"), (-end).alias("neg_end"), end.alias("end"), h["label"].alias("type"))

    staged = staged.withColumn("_cands", F.array_sort(F.transform("_hits", to_span)))
    kept = F.aggregate(
        F.col("_cands"),
        F.struct(F.lit(-1).alias("last_end"), F.array().cast(
            "array<struct<start:int,neg_end:int,end:int,type:string>>").alias("out")),
        lambda acc, c: F.when(c["start"] >= acc["last_end"],
                              F.struct(c["end"].alias("last_end"), F.concat(acc["out"], F.array(c)).alias("out")))
        .otherwise(acc),
        lambda acc: acc["out"])
    chunks = F.col("_chunks")
    spans = F.transform(kept, lambda c: F.struct(
        F.when(chunks.isNull(), F.substr(t, c["start"] + 1, c["end"] - c["start"])).otherwise(S._piece(chunks, c["start"], c["end"])).alias("text"), c["type"].alias("type"),
        c["start"].alias("start"), c["end"].alias("end")))
    return staged.withColumn("entity_spans", F.when(has, spans).otherwise(S.empty_spans())) \
        .drop("_toks", "_gaps", "_tend", "_chunks", "_hits", "_cands")


_MONTH = ("(?:January|February|March|April|May|June|July|August|September|October|November|December"
          "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)")
_DAY = r"(?:3[01]|[12][0-9]|0?[1-9])(?:st|nd|rd|th)?"
_YEAR = r"(?:,? (?:19|20)[0-9]{2})?"
_HOUR = r"(?:2[0-3]|[01]?[0-9])"
DATE_TIME_PATTERNS = [
    ("DATE", r"(?<![\w-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:3[01]|[12][0-9]|0[1-9])"
             rf"|{_DAY} {_MONTH}{_YEAR}|{_MONTH} {_DAY}{_YEAR}|{_MONTH} (?:19|20)[0-9]{{2}}"
             r"|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|[Tt]oday|[Tt]omorrow|[Yy]esterday)(?![\w-])"),
    ("TIME", rf"(?<![\w:]){_HOUR}(?::[0-5][0-9](?::[0-5][0-9])?(?: ?[AaPp][Mm])?| ?[AaPp][Mm])(?![\w:])"),
]


def add_date_time_spans(df: DataFrame, text_col: str, out: str = "date_time_spans") -> DataFrame:
    """D3: DATE and TIME spans of ``text_col`` (code points) by a small grammar: ISO dates, day and
    month in words with or without a year, weekdays, today and its neighbours; clock times of
    24 or 12 hours.  Column expressions only; concatenate with the gazetteer's spans for all
    entities.  A null text has none."""
    found = S.add_pattern_spans(df.withColumn("_dt", F.coalesce(F.col(text_col), F.lit(""))), "_dt", DATE_TIME_PATTERNS, out)
    return found.drop("_dt")


def model_entity_spans(text: Column, model_fn) -> Column:
    """Hook for a statistical NER model: ``model_fn(list[str]) ->
    list[list[(text, label, start, end)]]`` runs once per Arrow batch; labels
    outside ENTITY_LABELS are dropped."""
    keep = set(rules.ENTITY_LABELS)

    @F.pandas_udf(S.SPANS_TYPE)
    def _ner(texts: pd.Series) -> pd.Series:
        out = model_fn([t if isinstance(t, str) else "" for t in texts])
        return pd.Series([[{"text": a, "type": b, "start": int(c), "end": int(d)}
                           for a, b, c, d in ents if b in keep] for ents in out])

    return _ner(text)
