"""Cleaning and normalising columns (C01-C13). Null texts stay null unless stated; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"https?://\S+|www\.\S+"
# Markers that moderation leaves in place of a text.
STUB = r"\[removed\]|\[deleted\]|removed by moderator|deleted by user"
# Entities unescaped without Python, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title_and_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def epoch_to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def unescape(c: Column) -> Column:
    """Backslashes go, the common entities become characters."""
    c = F.regexp_replace(c, r"\\", "")
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_urls(c: Column, links: bool = True) -> Column:
    """URLs and, with ``links``, whole Markdown links become a space."""
    return F.regexp_replace(c, URL + (r"|\[[^\]]*\]\([^)]*\)" if links else ""), " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def longer_than(df: DataFrame, text: str, n: int = 30) -> DataFrame:
    """Rows whose text has more than ``n`` characters; null texts go."""
    return df.where(F.length(text) > n)


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text contains one of the literal terms; null counts as empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return out


def is_stub(c: Column, room: int = 200) -> Column:
    """Null or blank, or a moderation marker with fewer than ``room`` characters beside it."""
    t = F.trim(c)
    marker = F.regexp_extract(c, f"(?i)({STUB})", 1)
    return F.when(c.isNull() | (t == ""), True).when((marker != "") & (F.length(t) - F.length(marker) < room), True).otherwise(False)


def slug(c: Column, n: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, n)


def flat(c: Column, joint: str = " ") -> Column:
    return F.regexp_replace(c, "\n", joint)


def first_column(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that the table has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return found


def pointer(c: Column) -> Column:
    """``id (hint)`` to a struct of both; without brackets the whole is the id."""
    p = r"^(\S+)\s*\((.+)\)\s*$"
    hit = c.rlike(p)
    return F.struct(F.when(hit, F.regexp_extract(c, p, 1)).otherwise(c).alias("id"), F.when(hit, F.regexp_extract(c, p, 2)).alias("hint"))
