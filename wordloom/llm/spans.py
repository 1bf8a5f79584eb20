"""Spans of at least ``k`` characters that stand word for word in records of different threads.

Consecutive windows of ``k`` characters that share a minimiser travel as one packed string to the bucket of that
minimiser.  Only minimisers met in two threads are packed at all; equal strings of a minimiser are packed once.  In
a bucket the windows are sorted by hash and compared character by character.  Windows that the same strings hold make a class;
the classes and their members are the result, and pairs and extents are derived from them.  Buckets are sized by characters,
and a minimiser of very many isn't given to one task: its windows are grouped by Spark instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.storage import materialize

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 400_000  # characters hashed at once


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _window_minima(codes: np.ndarray, k: int, m: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The least m-mer hash of each window of ``k`` code points."""
    n = len(codes)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n])])
        h = (total[m:] - total[:-m]) * down[: n - m + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    w = k - m + 1
    size = -(-len(h) // w) * w
    blocks = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - k + 1
    return np.minimum(right[:count], left[w - 1 : w - 1 + count])


def super_windows(texts: list[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, minimiser, first character and length of every maximal run of windows with one minimiser."""
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, str]] = []
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - k + 1), _SEGMENT):
            pieces.append((i, at, t[at : at + _SEGMENT + k - 1]))
    pending: list[tuple[int, int, str]] = []
    held = 0
    up, down = _powers(2 * _SEGMENT + 2 * k)

    def flush() -> None:
        lengths = np.array([len(p) for _, _, p in pending])
        codes = np.frombuffer("".join(p for _, _, p in pending).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        least = _window_minima(codes, k, m, up, down)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # a window counts only where it ends inside its own text
        whose = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
        offset = np.arange(len(least)) - starts[whose]
        inside = offset + k <= lengths[whose]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (whose[1:] != whose[:-1])
        new &= inside
        first = np.flatnonzero(new)
        run = np.cumsum(new)[inside] - 1
        windows = np.bincount(run, minlength=len(first))
        no = np.array([i for i, _, _ in pending])
        base = np.array([at for _, at, _ in pending])
        out.append((no[whose[first]], least[first].view(np.int64), base[whose[first]] + offset[first], windows + k - 1))

    for p in pieces:
        if pending and held + len(p[2]) > _SEGMENT:
            flush()
            pending, held = [], 0
        pending.append(p)
        held += len(p[2])
    if pending:
        flush()
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _scan(k: int, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            no, mini, start, length = super_windows(pdf["text"].tolist(), k, m)
            yield pd.DataFrame({"mini": mini, "row": pdf["row"].to_numpy()[no], "thread": pdf["thread"].to_numpy()[no], "start": start, "length": length})

    return run


def _window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of ``k`` code points."""
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
        return (total[k:] - total[:-k]) * down[: len(codes) - k + 1]


def _equal_windows(pieces: list[str], k: int) -> Iterator[list[tuple[int, int]]]:
    """Windows that stand in two or more places of ``pieces``, each as its places (piece, first character)."""
    text = "".join(pieces)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = _window_hashes(codes, k)
    whose = np.repeat(np.arange(len(pieces)), lengths)[: len(h)]
    at = np.arange(len(h))
    at = at[at - starts[whose] + k <= lengths[whose]]  # windows inside one piece
    order = at[np.argsort(h[at], kind="stable")]
    ordered = h[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    for lo, hi in zip(edge[:-1], edge[1:]):
        if hi - lo < 2:
            continue
        same: dict[str, list[int]] = {}
        for p in order[lo:hi]:
            same.setdefault(text[p : p + k], []).append(int(p))
        for places in same.values():
            if len(places) > 1:
                yield [(int(whose[p]), int(p - starts[whose[p]])) for p in places]


def _count_windows(k: int):
    """Give, for each string of a bucket, the runs of its windows that strings of other threads, or it in two threads, hold as well."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("mini", "no", "pk", "a", "b")}
        for mini, group in pdf.groupby("mini", sort=False):
            pieces, keys = group["piece"].tolist(), group["pk"].tolist()
            lo, hi = group["tmin"].to_numpy(), group["tmax"].to_numpy()
            sets: dict[tuple[int, ...], int] = {}
            spans: dict[tuple[int, int], list[int]] = {}
            shared: dict[int, set[int]] = {}  # of each string, its windows that others hold

            def keep(held: list[tuple[int, int]]) -> None:
                members = tuple(sorted({i for i, _ in held}))
                if lo[list(members)].min() == hi[list(members)].max():
                    return  # one thread only
                no = sets.setdefault(members, len(sets))
                for i, a in held:
                    spans.setdefault((no, i), []).append(a)

            for held in _equal_windows(pieces, k):
                for i, a in held:
                    shared.setdefault(i, set()).add(a)
                keep(held)
            for i, piece in enumerate(pieces):
                if lo[i] != hi[i]:  # one string in two threads: what no other string holds
                    own = shared.get(i, ())
                    for a in range(len(piece) - k + 1):
                        if a not in own:
                            keep([(i, a)])
            for (no, i), at in spans.items():
                at.sort()
                begin = last = at[0]
                for a in [*at[1:], None]:
                    if a is not None and a <= last + 1:
                        last = a
                        continue
                    for c, v in zip(("mini", "no", "pk", "a", "b"), (mini, no, keys[i], begin, last)):
                        out[c].append(v)
                    if a is not None:
                        begin = last = a
        return pd.DataFrame(out).astype({"mini": "int64", "no": "int64", "a": "int64", "b": "int64"})

    return run


def thread_key(post_id: Column, row: Column) -> Column:
    """Threads are compared without outer blanks, letter case and a leading ``t3_``; a null or blank one equals none."""
    p = F.regexp_replace(F.lower(F.regexp_replace(post_id, r"^\s+|\s+$", "")), "^t3_", "")
    return F.xxhash64(F.when(p != "", F.concat(F.lit("p:"), p)).otherwise(F.concat(F.lit("r:"), row.cast("string"))))


class SharedSpans:
    """Spans that records of different threads share; ``records`` has row (unique long), thread (long) and text.

    Null texts and texts shorter than ``k`` share nothing.  Repeated rows of one thread aren't paired.  Texts may be
    of any length and are read whole.  An empty table gives empty results.  ``m`` is the minimiser's length, ``bucket``
    the characters of a bucket, and ``hot`` the characters of one minimiser's strings beyond which Spark groups its windows.
    """

    def __init__(self, records: DataFrame, *, k: int = 240, m: int | None = None, hot: int = 1_000_000, bucket: int = 500_000):
        self.k, self.m = k, m or k // 2
        texts = records.select("row", "thread", "text").where(F.length("text") >= k)
        # written once, as it is read twice: numbers only
        found = materialize(texts.mapInPandas(_scan(self.k, self.m), "mini long, row long, thread long, start long, length long"), "super-window-places")
        common = found.groupBy("mini").agg(F.min("thread").alias("lo"), F.max("thread").alias("hi")).where("lo != hi").select("mini")
        flagged = found.join(common, "mini", "left_semi")
        pieces = flagged.join(texts.select("row", "text"), "row").select("mini", "row", "thread", "start", F.substring("text", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("piece"))
        # written once: both the bucket's strings and their members read it
        self.pieces = materialize(pieces.withColumn("pk", F.md5(F.col("piece").cast("binary"))), "super-windows")
        strings = self.pieces.groupBy("mini", "pk").agg(F.first("piece").alias("piece"), F.min("thread").alias("tmin"), F.max("thread").alias("tmax"))
        sizes = strings.groupBy("mini").agg(F.sum(F.length("piece")).alias("n"))
        hot_minis = sizes.where(F.col("n") > hot).select("mini")
        stats = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).head()
        any_hot = (stats["most"] or 0) > hot
        # at least one bucket a core; the number is given, so that small ones aren't put together again
        buckets = max(records.sparkSession.sparkContext.defaultParallelism, -(-int(stats["n"] or 0) // bucket))
        cold = strings.join(hot_minis, "mini", "left_anti") if any_hot else strings
        runs = cold.withColumn("bucket", F.pmod("mini", F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_count_windows(k), "mini long, no long, pk string, a long, b long")
        self.runs = materialize(runs, "shared-runs")
        self._hot = self._hot_windows(strings.join(hot_minis, "mini", "left_semi")) if any_hot else None
        self._members: DataFrame | None = None

    def _hot_windows(self, strings: DataFrame) -> DataFrame:
        """mini, window, pk, at: windows of hot minimisers that stand in two threads; grouped by a digest of the window's text."""
        k = self.k
        at = F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("at")
        windows = strings.select("mini", "pk", "tmin", "tmax", "piece", at).withColumn("window", F.md5(F.expr(f"substring(piece, at + 1, {k})").cast("binary"))).drop("piece")
        shared = windows.groupBy("mini", "window").agg(F.min("tmin").alias("lo"), F.max("tmax").alias("hi")).where("lo != hi").select("mini", "window")
        return materialize(windows.join(shared, ["mini", "window"], "left_semi").select("mini", "window", "pk", "at"), "hot-windows")

    def members(self) -> DataFrame:
        """class, row, thread: the records that hold the windows of a class; classes of equal members are one.

        Which records a class has is compared by their number, least, largest and the sum of two hashes of them, so no class is
        gathered in one place.
        """
        if self._members is None:
            places = self.pieces.select("mini", "pk", "row", "thread").distinct()
            held = self.runs.select("mini", F.col("no").cast("string").alias("of"), "pk").distinct()
            if self._hot is not None:
                held = held.unionByName(self._hot.select("mini", F.col("window").alias("of"), "pk").distinct())
            of = held.join(places, ["mini", "pk"]).select(F.xxhash64("mini", "of").alias("class"), "row", "thread").distinct()
            of = materialize(of, "class-members")
            hashes = [F.sum(F.pmod(F.xxhash64("row", F.lit(i)), F.lit(1 << 40))).alias(f"h{i}") for i in (1, 2)]
            prints = of.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"), *hashes)
            first = prints.groupBy("n", "lo", "hi", "h1", "h2").agg(F.min("class").alias("class")).select("class")
            self._members = materialize(of.join(first, "class", "left_semi"), "distinct-class-members")
        return self._members

    def classes(self) -> DataFrame:
        """class, records, threads, links: how many records and threads share a class's span, and in how many pairs of different threads."""
        by = self.members().groupBy("class", "thread").agg(F.count(F.lit(1)).alias("n"))
        n = F.sum("n")
        return by.groupBy("class").agg(n.alias("records"), F.count(F.lit(1)).alias("threads"), ((n * n - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("links"))

    def pairs(self) -> DataFrame:
        """row_a < row_b: every two records of different threads that share a span; each once."""
        of = self.members()
        a, b = of.select("class", F.col("row").alias("row_a"), F.col("thread").alias("ta")), of.select("class", F.col("row").alias("row_b"), F.col("thread").alias("tb"))
        return a.join(b, "class").where("row_a < row_b AND ta != tb").select("row_a", "row_b").distinct()

    def extents(self) -> DataFrame:
        """row, shared_chars: how many characters of a record stand in a span shared with another thread."""
        spans = self.runs.select("mini", "pk", "a", "b")
        if self._hot is not None:
            spans = spans.unionByName(self._hot.select("mini", "pk", F.col("at").cast("long").alias("a"), F.col("at").cast("long").alias("b")))
        at = spans.join(self.pieces.select("mini", "pk", "row", "start"), ["mini", "pk"])
        return covered(at.select("row", (F.col("start") + F.col("a")).alias("lo"), (F.col("start") + F.col("b") + self.k).alias("hi")).distinct())


def covered(spans: DataFrame) -> DataFrame:
    """row, shared_chars: length of the union of the spans [lo, hi) of each row."""
    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(w), F.lit(0))
    return spans.withColumn("reach", reach).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "reach"))).alias("shared_chars"))
