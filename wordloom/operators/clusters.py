"""Agreement of clusterings and of coders, exemplars and density clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.storage import attach, broadcast_checked


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """ari: 1 for equal partitions, null with fewer than two items."""
    two = lambda c: c * (c - 1) / 2
    t = _contingency(df, a, b)
    cells = t.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    cols = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    x = attach(attach(cells, rows), cols)
    s, sa, sb = F.col("s"), F.col("sa"), F.col("sb")
    expected, most = sa * sb / two(F.col("n")), (sa + sb) / 2
    return x.select(F.round(F.when(F.col("n") < 2, None).when(most == expected, 1.0).otherwise((s - expected) / (most - expected)), 4).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """nmi by the arithmetic mean of both entropies; 1 where both are one cluster."""
    t = _contingency(df, a, b)
    n = F.sum("n").over(Window.partitionBy())
    w = t.select("a", "b", (F.col("n") / n).alias("p"), (F.sum("n").over(Window.partitionBy("a")) / n).alias("pa"), (F.sum("n").over(Window.partitionBy("b")) / n).alias("pb"))
    h = w.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("i"), (-F.sum(F.col("p") * F.log("pa"))).alias("ha"), (-F.sum(F.col("p") * F.log("pb"))).alias("hb"))
    return h.select(F.round(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("i") / (F.col("ha") + F.col("hb"))), 4).alias("nmi"))


def verdict(k: Column, ari: Column) -> Column:
    return F.when((k <= 1) | (ari < 0.20), "FALSIFIED").when(ari >= 0.40, "WORKS").otherwise("INCONCLUSIVE")


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """clusters without noise (-1) and the share of noise."""
    c = F.col(label)
    return df.agg(F.count_distinct(F.when(c != -1, c)).alias("clusters"), F.round(F.avg((c == -1).cast("int")), 4).alias("noise"))


def exemplars(df: DataFrame, key: str, vector: str, label: str, k: int = 10) -> DataFrame:
    """label, rank, key, distance: the ``k`` items nearest to the centroid of each cluster, noise left out."""
    d = df.where((F.col(label) != -1) & F.col(vector).isNotNull())
    mean = d.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m")).groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    x = d.join(broadcast_checked(mean, 2_000), label)  # a vector for each cluster
    dist = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("c"), lambda v, c: (v - c["m"]) * (v - c["m"])), F.lit(0.0), lambda s, v: s + v))
    w = Window.partitionBy(label).orderBy("distance", key)
    return x.withColumn("distance", F.round(dist, 4)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(label, "rank", key, "distance")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """agreement and Cohen's kappa of two coders; kappa is null where chance agreement is complete."""
    t = _contingency(df, a, b)
    n = t.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra = t.groupBy("a").agg(F.sum("n").alias("na"))
    rb = t.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    x = attach(n, chance).select((F.col("same") / F.col("n")).alias("po"), (F.col("both") / (F.col("n") * F.col("n"))).alias("pe"))
    return x.select(F.round("po", 4).alias("agreement"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 4).alias("kappa"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, summed in the order of the dimensions, so that a pair has the same distance in whichever block it stands."""
    out = np.zeros((len(x), len(y)))
    for i in range(0, len(x), 128):
        for k in range(x.shape[1]):
            out[i : i + 128] += (x[i : i + 128, k, None] - y[None, :, k]) ** 2
    return np.sqrt(out, out=out)


def _spanning_tree(d: np.ndarray, rank_x: np.ndarray, rank_y: np.ndarray | None) -> list[tuple[float, int, int]]:
    """Prim over the edges between x and y (or within x); ties go by the lower, then the higher rank, so there is one tree only."""
    n, nx = len(rank_x) + (0 if rank_y is None else len(rank_y)), len(rank_x)
    rank = rank_x if rank_y is None else np.concatenate([rank_x, rank_y])
    turned = d if rank_y is None else np.ascontiguousarray(d.T)
    best, tie, via, outside = np.full(n, np.inf), np.full(n, n * n), np.zeros(n, int), np.ones(n, bool)
    cur, tree = 0, []
    for _ in range(n - 1):
        outside[cur] = False
        best[cur] = np.inf
        far = slice(0, n) if rank_y is None else slice(nx, n) if cur < nx else slice(0, nx)
        w = d[cur] if cur < nx else turned[cur - nx]
        code = np.minimum(rank[cur], rank[far]) * n + np.maximum(rank[cur], rank[far])
        closer = outside[far] & ((w < best[far]) | ((w == best[far]) & (code < tie[far])))
        best[far], tie[far], via[far] = np.where(closer, w, best[far]), np.where(closer, code, tie[far]), np.where(closer, cur, via[far])
        least = np.flatnonzero(best == best.min())
        nxt = int(least[np.argmin(tie[least])])
        a, b = sorted((int(rank[via[nxt]]), int(rank[nxt])))
        tree.append((float(best[nxt]), a, b))
        cur = nxt
    return tree


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kruskal: of edges h, a < b those of the least spanning forest, in order of h, a, b."""
    pdf = pdf.sort_values(["h", "a", "b"])
    code, keys = pd.factorize(pd.concat([pdf["a"], pdf["b"]]))
    up, keep = list(range(len(keys))), []
    for x, y in zip(code[: len(pdf)].tolist(), code[len(pdf) :].tolist()):
        rx, ry = _find(up, x), _find(up, y)
        keep.append(rx != ry)
        up[rx] = ry
    return pdf[keep]


def _condense(tree: list[tuple[int, int]], heights: list[float], min_size: int) -> np.ndarray:
    """Cluster of each of the items 0 to n - 1, -1 for none, from the n - 1 edges of their tree in order of height."""
    n = len(tree) + 1
    up, size, kids, height = list(range(2 * n - 1)), [1] * n, {}, {}
    for new, ((a, b), h) in enumerate(zip(tree, heights), n):
        ra, rb = _find(up, a), _find(up, b)
        kids[new], height[new] = (ra, rb), h
        size.append(size[ra] + size[rb])
        up[ra] = up[rb] = new
    root, start, order = 2 * n - 2, [0] * (2 * n - 1), np.zeros(n, int)
    for i in range(root, n - 1, -1):
        a, b = kids[i]
        start[a], start[b] = start[i], start[i] + size[a]
    order[start[:n]] = np.arange(n)
    leaves = lambda i: order[start[i] : start[i] + size[i]]
    found, stack = [], [(root, 1 / max(height[root], 1e-12), -1)] if n > 1 else []
    while stack:  # clusters as [node, stability, number of the one above, children], those above first
        node, birth, above = stack.pop()
        found.append(mine := [node, 0.0, above, []])
        if above >= 0:
            found[above][3].append(len(found) - 1)
        while node >= n:
            a, b = kids[node]
            lam = 1 / max(height[node], 1e-12)
            if size[a] >= min_size and size[b] >= min_size:
                mine[1] += size[node] * (lam - birth)
                stack += [(a, lam, len(found) - 1), (b, lam, len(found) - 1)]
                break
            big, small = (a, b) if size[a] >= size[b] else (b, a)
            mine[1] += size[small] * (lam - birth)
            if size[big] < min_size:
                mine[1] += size[big] * (lam - birth)
                break
            node = big
    value, split = [f[1] for f in found], [False] * len(found)
    for i in range(len(found) - 1, -1, -1):
        if found[i][3] and (below := sum(value[c] for c in found[i][3])) > value[i]:
            value[i], split[i] = below, True
    chosen, stack = [], [0] if found else []
    while stack:
        i = stack.pop()
        if split[i]:
            stack += found[i][3]
        elif i:
            chosen.append(found[i][0])
    labels = np.full(n, -1)
    for no, c in enumerate(sorted(chosen, key=lambda c: leaves(c).min())):
        labels[leaves(c)] = no
    return labels


def density_clusters(df: DataFrame, group: str, key: str, vector: str, *, min_size: int = 5, block: int = 2_000, fold: int = 8) -> DataFrame:
    """group, key, cluster: single-linkage components over mutual reachability, cut where a component splits in two of ``min_size``.

    Exact for groups of any size; a key stands once in its group.  A group is spread by hash over blocks of about ``block`` items; each
    task holds the distances of one pair of blocks.  Core distances are merged from the pairs, and the spanning tree is folded, ``fold``
    forests a task, from the trees of the pairs, as an edge of the whole tree is in that of its pair.  The work grows with the square of
    the group; one task sees ``fold`` edges an item, never the vectors of a whole group.
    """
    f = {n: t for n, t in df.dtypes}
    g, k = f"_g {f[group]}", f[key]
    items = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(vector).alias("_v"))
    sizes = items.groupBy(F.col("_g").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    most = sizes.agg(F.max("blocks")).head()[0] or 1
    items = items.join(sizes, F.col("_g").eqNullSafe(F.col("g"))).drop("g").withColumn("at", F.pmod(F.xxhash64("_k"), F.col("blocks")).cast("int"))

    def paired(d: DataFrame) -> DataFrame:
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return d.withColumn("lo", F.least("at", "other")).withColumn("hi", F.greatest("at", "other")).groupBy("_g", "lo", "hi")

    def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], list[np.ndarray]]:
        pdf = pdf.sort_values("_k").reset_index(drop=True)
        ranks = [np.flatnonzero(pdf["at"] == at) for at in sorted({pdf["lo"].iloc[0], pdf["hi"].iloc[0]})]
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        return pdf, ranks, [x[r] for r in ranks]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ranks, xs = sides(pdf)
        d = _distances(xs[0], xs[-1])
        few = lambda m: np.sort(np.partition(m, min_size - 1, axis=1)[:, :min_size] if m.shape[1] > min_size else m, axis=1)
        parts = zip(ranks, (d, d.T))  # within one block the rows only
        return pd.concat([pd.DataFrame({"_g": pdf["_g"].iloc[r], "_k": pdf["_k"].iloc[r], "near": list(few(m))}) for r, m in parts])

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ranks, xs = sides(pdf)
        core = pdf["core"].to_numpy()
        d = _distances(xs[0], xs[-1])
        reach = np.maximum(np.maximum(d, core[ranks[0]][:, None]), core[ranks[-1]][None])
        edges = _spanning_tree(reach, ranks[0], ranks[1] if len(ranks) > 1 else None) if all(map(len, ranks)) else []
        h, a, b = zip(*edges) if edges else ([], [], [])
        keys = pdf["_k"]
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]] * len(h), "slot": [int(pdf["lo"].iloc[0])] * len(h), "h": np.array(h, float), "a": keys.iloc[list(a)].to_numpy(), "b": keys.iloc[list(b)].to_numpy()})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _forest(pdf)
        code, keys = pd.factorize(pd.concat([pdf["a"], pdf["b"]]), sort=True)
        n = len(pdf)
        labels = _condense(list(zip(code[:n].tolist(), code[n:].tolist())), pdf["h"].tolist(), min_size)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]] * len(keys), "_k": keys, "cluster": labels})

    near = paired(items).applyInPandas(nearest, f"{g}, _k {k}, near array<double>")
    core = near.groupBy(F.col("_g").alias("g"), F.col("_k").alias("k")).agg(F.element_at(F.sort_array(F.flatten(F.collect_list("near"))), min_size).alias("core"))
    cored = items.join(core, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_k") == F.col("k"))).drop("g", "k")
    edges = paired(cored).applyInPandas(tree, schema := f"{g}, slot int, h double, a {k}, b {k}")
    while most > 1:
        most = -(-most // fold)
        edges = edges.withColumn("slot", (F.col("slot") / fold).cast("int")).groupBy("_g", "slot").applyInPandas(_forest, schema)
    labels = edges.groupBy("_g").applyInPandas(label, f"{g}, _k {k}, cluster int")
    return df.select(group, key).join(labels, F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k")), "left").select(group, key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def support(seeds: DataFrame, hits: DataFrame, seed: str, least: int = 50) -> DataFrame:
    """seed, hits, status: ``kept`` from ``least`` hits on, ``too few`` below, ``skipped`` without any."""
    n = hits.groupBy(seed).agg(F.count(F.lit(1)).alias("hits"))
    x = seeds.join(n, seed, "left").select(seed, F.coalesce("hits", F.lit(0)).alias("hits"))
    return x.withColumn("status", F.when(F.col("hits") == 0, "skipped").when(F.col("hits") < least, "too few").otherwise("kept"))


def ari_matrix(df: DataFrame, key: str, model: str, size: str, label: str, noise: int | None = -1) -> DataFrame:
    """model_a, mcs_a, model_b, mcs_b, ari of every two configurations, each pair once; all pairs in one contingency table.

    Items whose label is ``noise`` in either are left out, with None they are a cluster.  Fewer than two items give null.
    """
    rows = df.where(F.lit(True) if noise is None else F.col(label) != noise)
    config = F.struct(F.col(model).alias("m"), F.col(size).alias("s"))
    a, b = (rows.select(key, config.alias(f"c{n}"), F.col(label).alias(n)) for n in "ab")
    cells = a.join(b, key).where("ca < cb").groupBy("ca", "cb", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = cells.groupBy("ca", "cb").agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    sides = [cells.groupBy("ca", "cb", x).agg(F.sum("n").alias("n")).groupBy("ca", "cb").agg(F.sum(two(F.col("n"))).alias(f"s{x}")) for x in "ab"]
    x = both.join(sides[0], ["ca", "cb"]).join(sides[1], ["ca", "cb"])
    expected, most = F.col("sa") * F.col("sb") / two(F.col("n")), (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.col("n") < 2, None).when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    return x.select(F.col("ca.m").alias("model_a"), F.col("ca.s").alias("mcs_a"), F.col("cb.m").alias("model_b"), F.col("cb.s").alias("mcs_b"), F.round(ari, 4).alias("ari"))


def ari_means(matrix: DataFrame, same_size: bool = True) -> DataFrame:
    """kind, mean_ari, pairs: ``cross`` over pairs of two models, with ``same_size`` at one size only, ``within`` over pairs in one model."""
    cross = F.col("model_a") != F.col("model_b")
    kept = matrix.where(~cross | (F.col("mcs_a") == F.col("mcs_b"))) if same_size else matrix
    return kept.groupBy(F.when(cross, "cross").otherwise("within").alias("kind")).agg(F.round(F.avg("ari"), 4).alias("mean_ari"), F.count(F.lit(1)).alias("pairs"))


def features(df: DataFrame, cluster: str, flags: list[str], category: str) -> DataFrame:
    """cluster, n, share of each flag, dominant category (the later name on a tie) and its distribution as ``name:count`` in order of name."""
    g = df.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.col(f).cast("int")).alias(f) for f in flags])
    named = F.col(category).isNotNull()
    pairs = F.array_sort(F.collect_list(F.when(named, F.struct(F.col(category).alias("v"), F.col("c")))))
    return g.groupBy(cluster).agg(
        F.sum("c").alias("n"),
        *[F.round(F.sum(f) / F.sum("c"), 4).alias(f) for f in flags],
        F.max(F.when(named, F.struct(F.col("c"), F.col(category).alias("v"))))["v"].alias("dominant"),
        F.nullif(F.array_join(F.transform(pairs, lambda x: F.concat(x["v"], F.lit(":"), x["c"].cast("string"))), ","), F.lit("")).alias("distribution"),
    )
