"""Small text helpers (B3, B7, B8, B9) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Python's str.isspace() also counts the four ASCII separators \x1c-\x1f.
_WS = r"[\s\x1c-\x1f]"


def py_strip(c: Column) -> Column:
    """``str.strip()`` (Unicode whitespace both ends); Spark ``trim`` only
    removes spaces."""
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")


def word_count(c: Column) -> Column:
    """``len(s.split())`` = number of maximal non-whitespace runs."""
    return F.regexp_count(c, F.lit(rf"(?U)[^\s\x1c-\x1f]+")).cast("long")


def truncate(c: Column, n: int) -> Column:
    """First n characters (null stays null)."""
    return F.substring(c, 1, n)


def estimated_tokens(c: Column) -> Column:
    """Characters / 4."""
    return F.length(c) / F.lit(rules.CHARS_PER_TOKEN)


def is_excessive(c: Column, max_tokens: int = rules.MAX_RESPONSE_TOKENS) -> Column:
    return estimated_tokens(c) > F.lit(max_tokens)
