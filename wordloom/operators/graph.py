"""Document co-occurrence graphs (K05-K16): vocabulary, weighted edges, statistics, communities, ego graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.tokens import top
from wordloom.storage import attach, broadcast_checked, materialize


def vocabulary(df: DataFrame, tokens: Column, k: int = 2000) -> DataFrame:
    """term, n: the ``k`` terms that stand in the most documents."""
    return top(df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), k)


def edges(df: DataFrame, tokens: Column, vocab: DataFrame, doc: str, at_least: int = 5) -> DataFrame:
    """src < dst, weight: documents that hold both terms, ``at_least`` so many.  Terms outside the vocabulary go first."""
    vocab = materialize(vocab, "vocabulary")  # counted, joined and read back
    terms = broadcast_checked(vocab.select("term", F.row_number().over(Window.orderBy("term")).alias("i")))  # numbers in order of the terms
    held = df.select(F.col(doc).alias("d"), F.explode(F.array_distinct(tokens)).alias("term")).join(terms, "term")
    sets = held.groupBy("d").agg(F.sort_array(F.collect_set("i")).alias("t")).where(F.size("t") > 1)
    a = sets.select("t", F.posexplode("t").alias("at", "a"))
    pairs = a.select(F.explode(F.transform(F.slice("t", F.col("at") + 2, F.size("t")), lambda b: F.shiftleft(F.col("a").cast("long"), 32) + b)).alias("ab"))
    counted = pairs.groupBy("ab").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= at_least).select(F.shiftright("ab", 32).cast("int").alias("a"), F.pmod("ab", F.lit(1 << 32)).cast("int").alias("b"), "weight")
    src, dst = (terms.select(F.col("i").alias(i), F.col("term").alias(t)) for i, t in (("a", "src"), ("b", "dst")))
    return counted.join(src, "a").join(dst, "b").select("src", "dst", "weight")


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("degree"))


def stats(e: DataFrame) -> DataFrame:
    """nodes, edges, density and average degree; 0 where there are fewer than two nodes."""
    n = degrees(e).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree") / 2, F.lit(0)).cast("long").alias("edges"))
    N, E = F.col("nodes"), F.col("edges")
    return n.select("nodes", "edges", F.round(F.when(N > 1, 2 * E / (N * (N - 1))).otherwise(0.0), 4).alias("density"), F.round(F.when(N > 0, 2 * E / N).otherwise(0.0), 4).alias("avg_degree"))


def ego(e: DataFrame, anchor: str) -> DataFrame:
    """Edges among the anchor and its neighbours."""
    near = e.where((F.col("src") == anchor) | (F.col("dst") == anchor)).select(F.explode(F.array("src", "dst")).alias("term")).distinct()
    return e.join(near.withColumnRenamed("term", "src"), "src", "left_semi").join(near.withColumnRenamed("term", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of labels (term, community)."""
    ls, ld = labels.select(F.col("term").alias("src"), F.col("community").alias("cs")), labels.select(F.col("term").alias("dst"), F.col("community").alias("cd"))
    total = e.agg(F.sum("weight").alias("m"))
    inside = e.join(ls, "src").join(ld, "dst").where("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.sum("weight").alias("w_in"))
    strength = e.select(F.explode(F.array("src", "dst")).alias("term"), "weight").join(labels, "term").groupBy("community").agg(F.sum("weight").alias("k"))
    c = attach(strength.join(inside, "community", "left"), total)
    return c.agg(F.round(F.sum(F.coalesce(F.col("w_in"), F.lit(0)) / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2), 4).alias("modularity"))


def _louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float) -> np.ndarray:
    """Greedy modularity by moving nodes and folding communities, on the dense matrix of the ``n`` nodes; nodes in order, so the result is stable."""
    graph = np.zeros((n, n))
    np.add.at(graph, (a, b), w)
    graph += graph.T
    m2 = graph.sum() or 1.0
    member = np.arange(n)
    while True:
        com, k = np.arange(len(graph)), graph.sum(1)
        tot, near = k.copy(), [np.flatnonzero(row) for row in graph]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in range(len(graph)):
                tot[com[i]] -= k[i]
                to = near[i][near[i] != i]
                gain = np.bincount(com[to], graph[i, to], len(graph))
                best, value = com[i], gain[com[i]] - resolution * tot[com[i]] * k[i] / m2
                for c in np.unique(com[to]).tolist():
                    v = gain[c] - resolution * tot[c] * k[i] / m2
                    if v > value + 1e-12:
                        best, value = c, v
                if best != com[i]:
                    com[i], moved, moved_any = best, True, True
                tot[com[i]] += k[i]
        member = com[member]
        if not moved_any:
            break
        names, to = np.unique(com, return_inverse=True)
        folded = np.zeros((len(names), len(names)))
        np.add.at(folded, (to[:, None], to[None]), graph)
        graph, member = folded, np.searchsorted(names, member)
    sizes = np.bincount(member)
    order = np.empty(len(sizes), int)
    order[np.lexsort((np.arange(len(sizes)), -sizes))] = np.arange(len(sizes))
    return order[member]


def communities(e: DataFrame, resolutions: list[float], most: int = 8_000_000) -> DataFrame:
    """resolution, community (0 the largest), size, term.

    A resolution is one task, so the edges are counted first: above ``most`` (those of a vocabulary of 4,000 terms that all stand
    together) the exact way doesn't fit it and ``label_propagation`` is to be used, another algorithm with other communities.
    """
    e = materialize(e, "edges")
    if e.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges; use label_propagation")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = float(pdf["resolution"].iloc[0])
        code, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]), sort=True)
        labels = pd.DataFrame({"term": names, "community": _louvain(code[: len(pdf)], code[len(pdf) :], pdf["weight"].to_numpy(float), len(names), r)})
        labels["size"] = labels.groupby("community")["term"].transform("size")
        return labels.assign(resolution=r)[["resolution", "community", "size", "term"]]

    return e.select("*", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution")).groupBy("resolution").applyInPandas(run, "resolution double, community long, size long, term string")


def duplicate_prefixes(df: DataFrame, text: str, n: int = 200) -> DataFrame:
    """Repeats of the first ``n`` characters, different prefixes, and texts of under 30 characters."""
    key = F.trim(F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, n)))
    g = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 30).alias("s"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("repeats"), F.count(F.lit(1)).alias("prefixes"), F.coalesce(F.sum("s"), F.lit(0)).alias("short"))


def adjacency(e: DataFrame, k: int = 200) -> DataFrame:
    """src, dst, weight: every cell of the matrix of the ``k`` terms of the highest degree, 0 without an edge."""
    names = top(degrees(e), k, n="degree").select("term")
    cells = names.select(F.col("term").alias("src")).join(F.broadcast(names.select(F.col("term").alias("dst"))), how="cross")  # k by k, whatever the corpus
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return cells.join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))


def prefix_examples(df: DataFrame, text: str, key: str, k: int = 5, n: int = 200) -> DataFrame:
    """prefix, copies, example: the ``k`` prefixes that most texts share, with the least key of each."""
    p = F.trim(F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, n)))
    g = df.groupBy(p.alias("prefix")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("example"))
    return g.where("copies > 1").orderBy(F.desc("copies"), "prefix").limit(k)


def ego_status(words: DataFrame, vocab: DataFrame, degree: DataFrame, least: int = 100) -> DataFrame:
    """term, df, status, neighbours: ``built`` where a word is frequent enough and has an edge, else what it lacks."""
    x = words.join(vocab.withColumnRenamed("n", "df"), "term", "left").join(degree, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    status = F.when(F.col("df") < least, "too rare").when(F.col("degree").isNull(), "no edge").otherwise("built")
    return x.select("term", "df", status.alias("status"), F.when(F.col("df") >= least, F.coalesce("degree", F.lit(0))).otherwise(0).alias("neighbours"))


def label_propagation(e: DataFrame, rounds: int = 10) -> DataFrame:
    """term, community: each term takes the label with the most weight among its neighbours and itself, the least on a tie.

    Joins and aggregations only, for graphs of any size; the labels of a round are written, so a lost executor costs one round.
    """
    both = materialize(e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "both-ways")
    labels = both.select(F.col("src").alias("term")).distinct().withColumn("community", F.col("term"))
    own = both.groupBy(F.col("src").alias("term")).agg(F.max("weight").alias("w"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("term").alias("dst"), "community"), "dst").select(F.col("src").alias("term"), "community", F.col("weight").alias("w"))
        votes = votes.unionByName(labels.join(own, "term").select("term", "community", "w")).groupBy("term", "community").agg(F.sum("w").alias("w"))
        labels = materialize(votes.groupBy("term").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community")), "labels")
    return labels
