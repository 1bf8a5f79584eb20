"""Tokens, frequencies, n-grams, skip-grams, collocations and corpus comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.clean import URL, strip_urls
from wordloom.storage import attach, broadcast_checked, materialize

# Function words left out on request, with four artefacts of noun lemmas.
STOPWORDS = tuple("""a about after again all also although am an and any are as at be because been before being but by can could did do does doing down during each even for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your wa ha doe wo""".split())


_splitter: ContextVar[Callable[[Column], Column] | None] = ContextVar("splitter", default=None)


@contextmanager
def splitting(by: Callable[[Column], Column]) -> Iterator[None]:
    """Within it ``words`` splits as ``by`` does."""
    was = _splitter.set(by)
    try:
        yield
    finally:
        _splitter.reset(was)


def words(c: Column) -> Column:
    """Lower-cased runs of three or more of a-z, split at every other character; URLs and links are no words."""
    if by := _splitter.get():
        return by(c)
    return F.filter(F.split(F.lower(strip_urls(F.coalesce(c, F.lit("")))), "[^a-z]+"), lambda w: F.length(w) >= 3)


def strict_words(c: Column) -> Column:
    """As ``words``, but a word beside a digit, underscore or other letter isn't one."""
    return F.regexp_extract_all(F.lower(strip_urls(F.coalesce(c, F.lit("")))), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0))


def loose_words(c: Column) -> Column:
    """Lower-cased words of letters, digits, apostrophes and hyphens; curly quotes count as straight ones."""
    t = F.translate(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+|www\.\S+", " ")), "‘’“”", "''\"\"")
    return F.filter(F.split(F.regexp_replace(t, r"[^a-z0-9 '\-]", " "), " +"), lambda w: w != "")


def content(tokens: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def lemma(w: Column) -> Column:
    """Plural nouns to singular by rule; stands in for a dictionary."""
    return (
        F.when(w.rlike("[^aeiou]ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:ss|sh|ch|x|z)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^sui]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def frequency(df: DataFrame, tokens: Column, by: list[str] | None = None) -> DataFrame:
    return df.select(*(by or []), F.explode(tokens).alias("term")).groupBy(*(by or []), "term").agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, k: int, by: list[str] | None = None, n: str = "n", term: str = "term") -> DataFrame:
    """The ``k`` most frequent, ties in order of the term, over all or in each group."""
    if not by:
        return df.orderBy(F.desc(n), term).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(n), term)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens of one document, joined by a space."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def skipgrams(df: DataFrame, tokens: Column, skip: int, compat: bool = False) -> DataFrame:
    """Pairs at most ``1 + skip`` apart; ``compat`` takes pairs up to ``2 + skip`` apart and counts a pair once for every window of ``2 + 2 * skip`` that holds it."""
    width = 2 + 2 * skip
    reach = skip + 2 if compat else skip + 1
    t = df.select(tokens.alias("t")).where(F.size("t") > 1)
    d = t.select("t", F.posexplode("t").alias("a", "first"))
    pairs = d.select(F.col("a"), "first", F.posexplode(F.slice("t", F.col("a") + 2, F.lit(reach))).alias("d", "second"))
    weight = F.least(F.lit(width) - (F.col("d") + 1), F.col("a") + 1) if compat else F.lit(1)
    return pairs.groupBy("first", "second").agg(F.sum(weight).cast("long").alias("n"))


def pmi(cooc: Column, total: Column, a: Column, b: Column) -> Column:
    return F.when((cooc > 0) & (a > 0) & (b > 0), F.log2(cooc * total / (a * b))).otherwise(F.lit(float("-inf")))


def collocations(df: DataFrame, tokens: Column, anchors: list[str], windows: list[int], *, at_least: int = 5, keep: int = 50) -> DataFrame:
    """anchor, width, term, cooc, anchor_n, freq, pmi: neighbours of each anchor, all anchors and widths in one job.

    Anchors are words; documents are arrays, so no pair crosses a document and no self-join is needed.
    """
    docs = df.select(tokens.alias("t"))
    spot = docs.where(F.arrays_overlap("t", F.array(*[F.lit(a) for a in anchors]))).select("t", F.posexplode("t").alias("pos", "anchor")).where(F.col("anchor").isin(*anchors))
    wide = spot.select("t", "pos", "anchor", F.explode(F.array(*[F.lit(w) for w in windows])).alias("width"))
    p = F.col("pos")
    near = F.concat(F.slice("t", F.greatest(p - F.col("width"), F.lit(0)) + 1, F.least(p, F.col("width"))), F.slice("t", p + 2, F.col("width")))
    cooc = wide.select("anchor", "width", F.explode(near).alias("term")).where(~F.col("term").isin(*STOPWORDS) & (F.col("term") != F.col("anchor"))).groupBy("anchor", "width", "term").agg(F.count(F.lit(1)).alias("cooc"))
    freq = materialize(frequency(docs, F.col("t")), "frequency")  # asked three times
    total = freq.agg(F.sum("n").alias("total"))
    anchor_n = freq.where(F.col("term").isin(*anchors)).select(F.col("term").alias("anchor"), F.col("n").alias("anchor_n"))
    rows = cooc.where(F.col("cooc") >= at_least).join(freq.withColumnRenamed("n", "freq"), "term").join(F.broadcast(anchor_n), "anchor")  # a row for each anchor
    rows = attach(rows, total)
    rows = rows.withColumn("pmi", F.round(pmi(F.col("cooc"), F.col("total"), F.col("anchor_n"), F.col("freq")), 4))
    w = Window.partitionBy("anchor", "width").orderBy(F.desc("pmi"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("anchor", "width", "term", "cooc", "anchor_n", "freq", "pmi", "rank")


def phrase_collocations(df: DataFrame, tokens: Column, anchors: DataFrame, windows: list[int], *, at_least: int = 5, keep: int = 50) -> DataFrame:
    """As ``collocations`` for anchors (seed, seed_tokens) of any number of tokens, of which none counts as a neighbour."""
    docs = df.select(tokens.alias("t"))
    at = hits(docs, F.col("t"), anchors, [])
    n, p, w = F.size("seed_tokens"), F.col("pos"), F.col("width")
    near = F.concat(F.slice("t", F.greatest(p - w, F.lit(0)) + 1, F.least(p, w)), F.slice("t", p + n + 1, w))
    wide = at.withColumn("width", F.explode(F.array(*[F.lit(x) for x in windows])))
    # one more term a place counts the places themselves in the same pass
    kept = F.filter(near, lambda x: ~F.array_contains("seed_tokens", x) & ~x.isin(*STOPWORDS))
    terms = wide.select(F.col("seed").alias("anchor"), "width", F.explode(F.concat(kept, F.array(F.lit("")))).alias("term"))
    counted = materialize(terms.groupBy("anchor", "width", "term").agg(F.count(F.lit(1)).alias("cooc")), "neighbours")
    cooc = counted.where((F.col("term") != "") & (F.col("cooc") >= at_least))
    anchor_n = counted.where((F.col("term") == "") & (F.col("width") == windows[0])).select("anchor", F.col("cooc").alias("anchor_n"))
    freq = materialize(frequency(docs, F.col("t")), "frequency")
    rows = cooc.join(freq.withColumnRenamed("n", "freq"), "term").join(broadcast_checked(anchor_n), "anchor")
    rows = attach(rows, freq.agg(F.sum("n").alias("total")))
    rows = rows.withColumn("pmi", F.round(pmi(F.col("cooc"), F.col("total"), F.col("anchor_n"), F.col("freq")), 4))
    r = Window.partitionBy("anchor", "width").orderBy(F.desc("pmi"), "term")
    return rows.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= keep).select("anchor", "width", "term", "cooc", "anchor_n", "freq", "pmi", "rank")


def compare_whole(a: DataFrame, b: DataFrame, k: int | None = 200) -> DataFrame:
    """As ``compare``, but each term has its true count on both sides; without ``k`` all terms are compared."""
    both = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), "term", "full_outer").na.fill(0, ["a", "b"])
    if k is not None:
        both = both.join(broadcast_checked(top(a, k).union(top(b, k)).select("term").distinct()), "term", "left_semi")
    rows = attach(attach(both, a.agg(F.sum("n").alias("na"))), b.agg(F.sum("n").alias("nb")))
    pa, pb = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    return rows.select("term", "a", "b", F.round(pa * 1000, 4).alias("a_per_1k"), F.round(pb * 1000, 4).alias("b_per_1k"), F.round(pa / F.greatest(pb, F.lit(1e-9)), 4).alias("ratio"))


def compare(a: DataFrame, b: DataFrame, k: int = 200) -> DataFrame:
    """term, a_per_1k, b_per_1k, ratio of the union of the ``k`` most frequent terms of both; true totals are the denominators."""
    total = lambda d, name: d.agg(F.sum("n").alias(name))
    ta, tb = top(a, k).select("term", F.col("n").alias("a")), top(b, k).select("term", F.col("n").alias("b"))
    rows = attach(attach(ta.join(tb, "term", "full_outer").na.fill(0, ["a", "b"]), total(a, "na")), total(b, "nb"))
    pa, pb = F.col("a") / F.col("na") * 1000, F.col("b") / F.col("nb") * 1000
    return rows.select("term", "a", "b", F.round(pa, 4).alias("a_per_1k"), F.round(pb, 4).alias("b_per_1k"), F.round((F.col("a") / F.col("na")) / F.greatest(F.col("b") / F.col("nb"), F.lit(1e-9)), 4).alias("ratio"))


def hits(df: DataFrame, tokens: Column, seeds: DataFrame, keep: list[str]) -> DataFrame:
    """keep, t, seed, seed_tokens, pos: every place where the tokens of a seed (seed, seed_tokens) follow one another."""
    s = broadcast_checked(seeds.select("seed", "seed_tokens", F.element_at("seed_tokens", 1).alias("head")).where(F.size("seed_tokens") > 0))
    rows = df.select(*keep, tokens.alias("t")).select(*keep, "t", F.posexplode("t").alias("pos", "head")).join(s, "head")
    n, p = F.size("seed_tokens"), F.col("pos")
    return rows.where(F.slice("t", p + 1, n) == F.col("seed_tokens")).select(*keep, "t", "seed", "seed_tokens", "pos")


def kwic(df: DataFrame, tokens: Column, seeds: DataFrame, width: int | list[int], keep: list[str]) -> DataFrame:
    """keep, seed, pos, left, right of the ``hits``; several widths give a row and a column ``width`` each."""
    hit = hits(df, tokens, seeds, keep)
    if isinstance(width, list):
        hit, keep, w = hit.withColumn("width", F.explode(F.array(*[F.lit(x) for x in width]))), [*keep, "width"], F.col("width")
    else:
        w = F.lit(width)
    n, p = F.size("seed_tokens"), F.col("pos")
    left = F.slice("t", F.greatest(p - w, F.lit(0)) + 1, F.least(p, w))
    return hit.select(*keep, "seed", "pos", F.array_join(left, " ").alias("left_context"), F.array_join(F.slice("t", p + n + 1, w), " ").alias("right_context"))


def raw_tokens(c: Column) -> Column:
    """Tokens between white space, URLs left out, in their own case; an empty or null text has none."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), URL, " ")), "[ \\t\\r\\n]+"), lambda x: x != "")


def sense_contexts(df: DataFrame, text: str, seeds: DataFrame, keep: list[str], width: int = 20, compat: bool = False) -> DataFrame:
    """keep, seed, pos, seed_token, left_context, right_context: every place where a seed's tokens stand, in any case.

    ``compat`` centres on the token before the seed, as the second variant does, or on the first token of a text.  Seeds
    are joined by their first token, so a text meets only seeds that can stand in it.
    """
    s = seeds.select("seed", F.transform(raw_tokens(F.col("seed")), F.lower).alias("__s")).where(F.size("__s") > 0)
    at = df.select(*keep, raw_tokens(F.col(text)).alias("__t")).select(*keep, "__t", F.posexplode("__t").alias("pos", "x"))
    hit = at.join(broadcast_checked(s.withColumn("__f", F.element_at("__s", 1))), F.lower("x") == F.col("__f"))
    n = F.size("__s")
    hit = hit.where(F.transform(F.slice("__t", F.col("pos") + 1, n), F.lower) == F.col("__s"))
    if compat:
        hit = hit.withColumn("pos", F.greatest(F.col("pos") - 1, F.lit(0)))
        n = F.lit(1)
    left = F.array_join(F.slice("__t", F.greatest(F.col("pos") - width, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(width))), " ")
    right = F.array_join(F.slice("__t", F.col("pos") + n + 1, F.lit(width)), " ")
    return hit.select(*keep, "seed", "pos", F.array_join(F.slice("__t", F.col("pos") + 1, n), " ").alias("seed_token"), left.alias("left_context"), right.alias("right_context"))


def category_rates(freq: DataFrame, dim: DataFrame, by: str) -> DataFrame:
    """category, by, n, per_1k: what a thousand words of each stratum have of a category's terms; ``freq`` has by, term and n, ``dim`` category and term."""
    total = freq.groupBy(by).agg(F.sum("n").alias("__total"))
    n = freq.join(broadcast_checked(dim.distinct()), "term").groupBy("category", by).agg(F.sum("n").alias("n"))
    every = dim.select("category").distinct().join(broadcast_checked(total), how="cross")  # categories by strata, both counted
    return every.join(n, ["category", by], "left").select("category", by, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) * 1000.0 / F.col("__total"), 4).alias("per_1k"))
