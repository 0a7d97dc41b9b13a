"""Policies: decode (A4), data-driven matching (C9), latest state from a change
log (H10) and default seeding (H11)."""

from __future__ import annotations

import json

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from .joins import bounded_rows, filter_bits, key_filter, may_hold, sorted_join
from .partitioning import explode_computed

INLINE_BYTES = 1 << 20  # patterns put into the scan as an expression, together
GRAM_SIZES = (1, 2, 3, 8)  # a pattern is keyed by runs of the largest size that it holds

POLICY_CONFIG_TYPE = T.StructType([
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("redact", T.BooleanType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("check_secrets", T.BooleanType()),
    T.StructField("enabled", T.BooleanType()),
])
POLICY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])


def _pretty_one(c):
    if c is None:
        return None
    try:
        return json.dumps(json.loads(c), indent=2)
    except ValueError:
        return c


def _pretty_json(col):
    """Two-space indented JSON, or the raw text when it does not parse.
    Display-only, over the configuration-sized policies table (an Arrow-batched
    pandas UDF, created on first use)."""
    @F.pandas_udf("string")
    def pretty(configs: pd.Series) -> pd.Series:
        return configs.map(_pretty_one)

    return pretty(col)


def decode_policies(policies: DataFrame, display: bool = True) -> DataFrame:
    """A4: typed config (``from_json``), validity (``try_parse_json``) and, for
    display, the pretty-printed text (raw text kept if invalid)."""
    valid = F.try_parse_json("config").isNotNull()
    parsed = F.when(valid, F.from_json("config", POLICY_CONFIG_TYPE))
    out = policies.withColumn("config_parsed", parsed).withColumn("config_valid", valid)
    return out.withColumn("config_display", _pretty_json("config")) if display else out


def default_policies(spark: SparkSession, as_of: str) -> DataFrame:
    rows = [(i + 1, n, t, c, True) for i, (n, t, c) in enumerate(rules.DEFAULT_POLICIES)]
    df = spark.createDataFrame(rows, "id long, name string, type string, config string, enabled boolean")
    return df.withColumn("last_updated", F.lit(as_of).cast("timestamp_ntz"))


def seed_if_empty(spark: SparkSession, policies: DataFrame | None, as_of: str) -> DataFrame:
    """The default policies when the table is empty (or missing)."""
    if policies is None or bounded_rows(policies, 0):
        return default_policies(spark, as_of)
    return policies


def policy_patterns(policies: DataFrame) -> DataFrame:
    """Enabled policies exploded to one (policy, type, ordinal, pattern) row."""
    d = decode_policies(policies, display=False).where(F.col("enabled") & F.col("config_valid"))
    return d.select("name", "type", F.posexplode(F.coalesce(F.col("config_parsed.patterns"),
                                                             F.array().cast("array<string>"))).alias("ordinal", "pattern")) \
        .where(F.col("pattern").isNotNull() & (F.col("pattern") != "")) \
        .withColumn("pattern_lc", F.lower("pattern"))


def _runs(text, sizes) -> Column:
    """The distinct runs of ``sizes`` characters of ``text``, each size in one pass."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def _run_size(text: Column) -> Column:
    """The largest of ``GRAM_SIZES`` that ``text`` holds; null for a null or empty text."""
    return F.coalesce(*[F.when(F.length(text) >= n, F.lit(n)) for n in sorted(GRAM_SIZES, reverse=True)])


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(pattern_lc, key): one row per distinct text among the patterns.  ``key`` is, of its runs of
    its size (``GRAM_SIZES``), the one that the fewest texts hold, then the smallest.  So
    patterns with a common beginning, such as numbered names, do not meet every text that holds it."""
    size = _run_size(F.col("pattern_lc"))
    runs = F.coalesce(*[F.when(size == n, _runs(F.col("pattern_lc"), [n])) for n in GRAM_SIZES])
    runs = patterns.select("pattern_lc").distinct().select("pattern_lc", explode_computed(runs, "key")).where(F.col("key").isNotNull())
    held = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n_patterns"))
    rarest = sorted_join(runs, held, "key").groupBy("pattern_lc").agg(F.min(F.struct("n_patterns", "key")).alias("k"))
    return rarest.select("pattern_lc", F.col("k.key").alias("key"))


def keyed_patterns(patterns: DataFrame) -> DataFrame:
    """``patterns`` (distinct rows, ``n_rows`` of each) with the ``key`` of ``pattern_keys``."""
    rows = patterns.groupBy("name", "ordinal", "pattern", "pattern_lc").agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    return sorted_join(rows, pattern_keys(patterns), "pattern_lc")


def literal_matches(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame,
                    max_broadcast_rows: int = 256) -> DataFrame:
    """(id, name, ordinal, pattern) for every row and pattern contained in its
    text, ignoring case.

    Up to ``max_broadcast_rows`` patterns of at most ``INLINE_BYTES`` together
    become one expression of the scan, without a join.  More of them meet the
    texts by an exact equi-join: a pattern is keyed by its rarest run of
    characters (``pattern_keys``), a text by its distinct runs of the sizes that
    the patterns have.  Runs that are no pattern's key are dropped by a Bloom filter,
    as large as the number of patterns asks, before they shuffle; the candidates return to the texts by the text's hash and are
    checked with ``contains``.  Pattern rows of the same text travel as one and are
    told apart in the last join, so rows that repeat a name multiply the result,
    not the shuffles.  No table is broadcast.  Null texts match nothing; null and repeated ids keep their rows."""
    t = texts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_lc"))
    size = patterns.limit(max_broadcast_rows + 1).agg(
        F.count(F.lit(1)), F.sum(F.octet_length("pattern") + F.octet_length("name"))).first()
    if 0 < size[0] <= max_broadcast_rows and (size[1] or 0) <= INLINE_BYTES:
        kinds = {c: patterns.schema[c].dataType for c in ("name", "ordinal", "pattern")}
        hits = [F.when(F.col("_lc").contains(p["pattern_lc"]),
                       F.struct(*[F.lit(p[c]).cast(k).alias(c) for c, k in kinds.items()])) for p in patterns.collect()]
        found = t.select("_id", explode_computed(F.array_compact(F.array(*hits)), "_m")).where(F.col("_m").isNotNull())
        return found.select(F.col("_id").alias(id_col), "_m.name", "_m.ordinal", "_m.pattern")
    # rows of one pattern text are one candidate: only what is found meets them all
    seen = patterns.agg(F.approx_count_distinct("pattern_lc"), F.collect_set(_run_size(F.col("pattern_lc")))).first()
    sizes, bits = sorted(seen[1]) or GRAM_SIZES[:1], filter_bits(seen[0])
    keyed = pattern_keys(patterns)
    grams = t.select(F.xxhash64("_lc").alias("_tk"), explode_computed(_runs(F.col("_lc"), sizes), "key"))
    grams = grams.where(F.col("key").isNotNull() & may_hold(F.col("key"), key_filter(keyed, bits).scalar(), bits))
    pairs = sorted_join(grams, keyed, "key").select("_tk", "pattern_lc").distinct()
    checked = sorted_join(t.withColumn("_tk", F.xxhash64("_lc")), pairs, "_tk").where(F.col("_lc").contains(F.col("pattern_lc")))
    each = sorted_join(checked.select("_id", "pattern_lc"), patterns.select("name", "ordinal", "pattern", "pattern_lc"), "pattern_lc")
    return each.select(F.col("_id").alias(id_col), "name", "ordinal", "pattern")


def policy_matches(texts: DataFrame, id_col: str, text_col: str, policies: DataFrame, policy_type: str,
                   **kw) -> DataFrame:
    """Per text and policy, the matched patterns in declaration order."""
    pats = policy_patterns(policies).where(F.col("type") == policy_type)
    m = literal_matches(texts, id_col, text_col, pats, **kw)
    return m.groupBy(id_col, "name").agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.array_sort(F.collect_list(F.struct("ordinal", "pattern"))).alias("_m")) \
        .select(id_col, F.col("name").alias("policy"), "n_matched",
                F.transform("_m", lambda x: x["pattern"]).alias("matched"))


def policy_snapshot(changes: DataFrame) -> DataFrame:
    """Latest state per policy name from a change log
    (change_id, name, op create/update/toggle, type, config, enabled, ts).

    The first create with valid JSON defines the policy; later creates of the
    name (repeats of the first row too) are rejected as duplicates, invalid JSON is
    rejected; updates change the config, toggles the enabled flag, each only after
    the create.  The last update or toggle of a name counts if it stands after the
    name's create, so one aggregation by name is enough (partial aggregation
    absorbs hot names); equal (ts, change_id) go by the larger value."""
    valid_json = F.try_parse_json("config").isNotNull()
    op = F.col("op")
    at = [F.col("ts"), F.col("change_id")]
    made, edit, switch = (op == "create") & valid_json, (op == "update") & valid_json, op == "toggle"
    agg = changes.groupBy("name").agg(
        F.min(F.when(made, F.struct(*at, "type", "config"))).alias("c"),
        F.max(F.when(edit, F.struct(*at, "config"))).alias("u"),
        F.max(F.when(switch, F.struct(*at, "enabled"))).alias("t"),
        (F.count_if(op.isin("create", "update") & ~valid_json) + F.count_if(made) - 1).alias("n_rejected"))
    created = F.struct("c.ts", "c.change_id")
    upd = F.when(F.struct("u.ts", "u.change_id") > created, F.col("u"))
    tog = F.when(F.struct("t.ts", "t.change_id") > created, F.col("t"))
    return agg.where(F.col("c").isNotNull()).select(
        "name", F.col("c.type").alias("type"),
        F.coalesce(upd["config"], F.col("c.config")).alias("config"),
        F.coalesce(tog["enabled"], F.lit(True)).alias("enabled"),
        F.greatest(F.col("c.ts"), upd["ts"], tog["ts"]).alias("last_updated"),
        "n_rejected")
