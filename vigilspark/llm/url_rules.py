"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A rule is a host and a path prefix.  Each distinct URL is expanded into the
expressions (host suffix at a label boundary + path prefix) whose shape (number
of labels, path length) some rule has; expressions meet rules by an equi-join on
the first 32 bits of their SHA-256, and a hit counts only if the full digests
agree.  Of a URL's rules the longest (host + path characters) wins, then the
longer host, then ``block``; URLs that no rule fits get ``default``.

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default; a rule with a null part is ignored; repeated rows and ids give
a row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_HEX = 8  # hex digits of the digest that are joined on


def parts(pages: DataFrame, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, path) of every row."""
    url = F.col(url_col)
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return pages.select(F.col(id_col).alias("page_id"), has.alias("has"), after.alias("after"), host.alias("raw")).select(
        "page_id", F.when(F.col("has"), ascii_lower(F.col("raw"))).otherwise("").alias("host"),
        F.when(F.col("has"), F.regexp_extract(F.expr("substring(after, length(raw) + 1)"), r"^[^?#]*", 0)).otherwise("").alias("path"))


def _digest(expression):
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, verdict) -> with digest and shape; ``block`` beats
    ``allow`` for the same expression."""
    r = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return r.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", _digest(F.concat("host", F.lit("\n"), "path")).alias("digest"),
                    F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col="page_id", url_col="url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules``: (host, path, verdict 'allow' or 'block').  The rules may be many:
    they are joined by key.  Only their distinct shapes reach the driver (label
    counts times path lengths, a few hundred for any list)."""
    table = rule_table(rules)
    shapes = [tuple(x) for x in table.select("labels", "chars").distinct().collect()]
    p = parts(pages, id_col, url_col)
    if not shapes:
        return p.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = p.select("host", "path").distinct()
    shape = F.explode(F.lit([f"{a}:{b}" for a, b in shapes]))
    e = urls.withColumn("labels_of", F.split("host", r"\.", -1)).select("host", "path", "labels_of", shape.alias("shape"))
    e = e.select("host", "path", "labels_of", F.split_part("shape", F.lit(":"), F.lit(1)).cast("int").alias("labels"), F.split_part("shape", F.lit(":"), F.lit(2)).cast("int").alias("chars"))
    e = e.where((F.size("labels_of") >= F.col("labels")) & (F.length("path") >= F.col("chars")))
    suffix = F.array_join(F.expr("slice(labels_of, -labels, labels)"), ".")
    e = e.select("host", "path", _digest(F.concat(suffix, F.lit("\n"), F.expr("substring(path, 1, chars)"))).alias("digest"))
    e = e.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    r = table.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).withColumnRenamed("digest", "rule_digest")
    hits = e.join(r, "prefix").where(F.col("digest") == F.col("rule_digest"))
    size = F.length("rule_host") + F.length("rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("h"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    out = p.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
