"""Term tagging and pattern search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.clean import slug
from wordloom.storage import bounded

MAX_TERMS = 5_000


def read_terms(terms: DataFrame) -> list[dict]:
    """Term rows in order of the term; refused above ``MAX_TERMS``, as each becomes part of the expression: ``tag_blocks`` takes any number."""
    rows, fits = bounded(terms.where(F.col("term").isNotNull()).select("term", "confidence", "retrieval_action").distinct().orderBy("term"), MAX_TERMS)
    if not fits:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return [r.asDict() for r in rows]


def _compiles(pattern: str) -> bool:
    try:
        SparkSession.getActiveSession().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):  # which of them depends on the session
        return False
    return True


def matches(text: Column, term: dict) -> Column:
    """Literal terms match as substrings in any case, terms marked ``regex`` as patterns if they compile in the engine that runs them."""
    if term.get("retrieval_action") == "regex" and _compiles("(?i)" + term["term"]):
        return text.rlike("(?i)" + term["term"])
    return F.contains(F.lower(text), F.lit(term["term"].lower()))


def tag(df: DataFrame, text: str, terms: list[dict], out: str = "matched") -> DataFrame:
    """Add the array of matched terms in term order, empty for null texts."""
    c = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.array_compact(F.array(*[F.when(matches(c, t), F.lit(t["term"])) for t in terms])))


def tag_blocks(df: DataFrame, key: str, text: str, terms: DataFrame, block: int = 100_000) -> DataFrame:
    """key, term: every literal term that stands in a text, in any case, for any number of terms.

    A block of terms is one automaton, which a text is read through once however many terms there are; more terms are
    more blocks.  ``key`` must be unique; null texts and null or empty terms match nothing.
    """
    import ahocorasick

    t = terms.where(F.col("term").isNotNull() & (F.col("term") != "")).select("term").distinct()
    blocks = max(1, -(-t.count() // block))
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def matcher(words: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = ahocorasick.Automaton()
            for w in words:
                low = w.lower()
                a.add_word(low, (*a.get(low, ()), w))
            if words:
                a.make_automaton()
            for pdf in batches:
                out = [(k, w) for k, x in zip(pdf["k"], pdf["t"]) for w in (sorted({w for _, ws in a.iter(x.lower()) for w in ws}) if words else ())]
                yield pd.DataFrame(out, columns=[key, "term"])

        return run

    found = None
    for i in range(blocks):
        words = [r["term"] for r in (t if blocks == 1 else t.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i)).toLocalIterator()]
        part = rows.mapInPandas(matcher(words), f"`{key}` {kind}, term string")
        found = part if found is None else found.unionByName(part)
    return found


def first_match(df: DataFrame, matched: str = "matched", prefix: str = "fresh_") -> DataFrame:
    """Rows with a match: the first term, all terms joined by ``|``, and the prefixed slug of the first."""
    first = F.element_at(matched, 1)
    return df.where(F.size(matched) > 0).withColumns({"retrieval_term": first, "all_matched": F.array_join(matched, "|"), "term_source": F.concat(F.lit(prefix), slug(first))})


def auto_code(text: Column, phrases: list[str]) -> tuple[Column, Column]:
    """``TP`` and its first phrase, ``borderline`` without one, ``''`` for null and blank texts."""
    low = F.lower(text)
    phrase = F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases])
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, "").when(phrase.isNotNull(), "TP").otherwise("borderline"), F.when(~blank, phrase)


def precision(code: Column) -> Column:
    return F.avg(F.when(code == "TP", 1.0).when(code == "borderline", 0.5).otherwise(0.0))


def saturated(net_new: Column, posts: Column, prec: Column) -> Column:
    return F.when(prec.isNull() | (prec < 0.5), True).otherwise(net_new / posts <= 0.10)


def shape(term: Column) -> Column:
    n = F.size(F.split(F.trim(term), r"\s+"))
    return F.when(n >= 4, "phrasal (long)").when(n >= 2, "phrasal").when(F.contains(term, F.lit("-")), "compound").otherwise("unigram")


def proximity(df: DataFrame, text: str, a: str, b: str, *, reach: int = 1500, margin: int = 150, keep: list[str]) -> DataFrame:
    """Rows whose first match of ``a`` and of ``b`` start at most ``reach`` apart: both matches and the text around them."""
    c = F.col(text)
    at = lambda p: F.regexp_instr(c, F.lit(p))
    size = lambda p: F.length(F.regexp_substr(c, F.lit(p)))
    rows = df.select(*keep, text, at(a).alias("__a"), at(b).alias("__b"), size(a).alias("__la"), size(b).alias("__lb")).where((F.col("__a") > 0) & (F.col("__b") > 0) & (F.abs(F.col("__a") - F.col("__b")) <= reach))
    low = F.greatest(F.least("__a", "__b") - margin, F.lit(1))
    high = F.least(F.greatest(F.col("__a") + F.col("__la"), F.col("__b") + F.col("__lb")) - 1 + margin, F.length(c))
    part = lambda p, n: F.substring(F.substring(c, F.col(p), F.col(n)), 1, 80)
    return rows.select(*keep, part("__a", "__la").alias("match_a"), part("__b", "__lb").alias("match_b"), F.substring(c, low, high - low + 1).alias("context"))


def priority(df: DataFrame, text: str, patterns: list[str], keep: list[str], context: int | None = None) -> DataFrame:
    """keep, pattern_id, match: the first pattern in the list that matches a text wins; with ``context``, that many characters on either side too."""
    c = F.col(text)
    which = F.coalesce(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    found = df.select(*keep, text, which.alias("pattern_id")).where(F.col("pattern_id").isNotNull())
    pick = lambda f: F.coalesce(*[F.when(F.col("pattern_id") == i, f(c, F.lit(p))) for i, p in enumerate(patterns)])
    out = found.withColumn("match", pick(F.regexp_substr))
    if context is None:
        return out.select(*keep, "pattern_id", "match")
    at = F.instr(c, F.col("match"))
    low = F.greatest(at - context, F.lit(1))
    return out.select(*keep, "pattern_id", "match", F.substring(c, low, at + F.length("match") + context - low).alias("context"))


def windows_around(text: str, terms: list[str], before: int = 1100, after: int = 500, gap: int = 200) -> list[tuple[int, int]]:
    """Stretches around every place of a term (in any case), those at most ``gap`` apart made one, snapped to sentences.

    A stretch begins after the first ``". "`` within 250 characters of its start, and ends with the last one between 250
    characters before its end and 120 after it; without one it stays.
    """
    low = text.lower()
    at = sorted({m.start() for t in terms for m in re.finditer(re.escape(t.lower()), low)})
    islands: list[list[int]] = []
    for p in at:
        a, b = max(0, p - before), min(len(text), p + after)
        if islands and a <= islands[-1][1] + gap:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    out = []
    for a, b in islands:
        if a:
            s = text.find(". ", a, a + 250)
            a = s + 2 if s >= 0 else a
        if b < len(text):
            e = text.rfind(". ", max(a, b - 250), b + 120)
            b = e + 1 if e >= 0 else b
        out.append((a, b))
    return out


def excerpts(df: DataFrame, text: str, key: str, terms: list[dict], separator: str = "\n[...]\n") -> DataFrame:
    """key, places, excerpt: the evidence around the terms of each text; null where no term stands. Null texts give null."""
    words = [t["term"] for t in terms if t["term"]]
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [windows_around(t or "", words) for t in pdf["t"]]
            yield pd.DataFrame({key: pdf["k"], "places": [len(f) for f in found], "excerpt": [separator.join(t[a:b] for a, b in f) if f else None for t, f in zip(pdf["t"], found)]}).astype({"excerpt": "object"})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, places int, excerpt string")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: int = 200) -> DataFrame:
    """Intervals of a key at most ``gap`` apart become one: key, start, end."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    d = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
