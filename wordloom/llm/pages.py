"""Page differencing: lines that a page shares with the nearest page of its host are its frame, not its text.

Pages are sorted by host, path and id; of its two neighbours in this order a page is paired with the one of the same host
whose path has the longer common beginning.  Their lines are aligned by longest common subsequence, and lines in it are
deleted.  The order is made by ranges and places, so a host of any size is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.relational import global_rank
from wordloom.storage import materialize


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of lines, by bit vectors: one integer of len(b) bits a line."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for line in x:  # a zero bit j of row i: the subsequence of x[:i+1] and y[:j+1] is longer than of y[:j]
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    kept, j = [], len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        before = rows[i - 1] if i else full
        # y[:j+1] gains nothing from x[i] if the zeros up to j are as many without it
        mask = (1 << (j + 1)) - 1
        if j < 0:
            break
        if (~rows[i] & mask).bit_count() > (~before & mask).bit_count():
            zeros = ~rows[i] & mask
            j = zeros.bit_length() - 1
            while not (where.get(x[i], 0) >> j) & 1:  # the last place of this line that the longest can end in
                j -= 1
            kept.append(low + i)
            j -= 1
    return [*range(low), *reversed(kept), *range(len(a) - high, len(a))]


def _difference(text: str, other: str | None) -> tuple[str, int]:
    if other is None:
        return text, 0
    lines = text.splitlines()
    blank = [i for i, x in enumerate(lines) if not x.strip()]
    gone = set(common_lines(lines, other.splitlines())) - set(blank)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def difference_pages(df: DataFrame, *, url: str = "url", text: str = "text", id_col: str = "page_id") -> DataFrame:
    """id_col, clean_text, removed: each page without the lines that it shares with its nearest page, and how many these are.

    ``id_col`` must be unique.  A page without a neighbour in its host, without a host or with a null text stays as it is;
    on a tie the neighbour before is taken.  Blank lines are never deleted.  Hosts are compared in lower case.
    """
    u = F.col(f"`{url}`")
    keys = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.lower(F.regexp_extract(u, r"^(?i:[a-z][a-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)).alias("host"),
        F.regexp_extract(u, r"^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1).alias("path"),
        F.col(f"`{text}`").alias("text"),
    )
    able = keys.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("text").isNotNull())
    placed = materialize(global_rank(able.select("id", "host", "path"), [F.col("host"), F.col("path"), F.col("id")]), "page-places")
    near = [placed.select((F.col("place") + step).alias("place"), F.col("host").alias(f"h{n}"), F.col("path").alias(f"p{n}"), F.col("id").alias(f"i{n}")) for n, step in (("a", 1), ("b", -1))]
    both = placed.join(near[0], "place", "left").join(near[1], "place", "left")
    # characters that both paths begin with; -1 beside another host or none
    size = lambda n: F.least(F.length("path"), F.length(f"p{n}"))
    same = lambda n: F.size(F.filter(F.sequence(F.lit(0), size(n)), lambda k: F.substring("path", 1, k) == F.substring(f"p{n}", 1, k))) - 1
    a, b = (F.when(F.col(f"h{n}") == F.col("host"), same(n)).otherwise(-1) for n in "ab")
    chosen = both.select("id", F.when((a >= 0) & (a >= b), F.col("ia")).when(b >= 0, F.col("ib")).alias("near"))
    texts = keys.select("id", "text")
    pairs = texts.join(chosen, "id", "left").join(texts.select(F.col("id").alias("near"), F.col("text").alias("other")), "near", "left").select("id", "text", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, None, 0) if t is None else (i, *_difference(t, o)) for i, t, o in zip(pdf["id"], pdf["text"], pdf["other"])]
            yield pd.DataFrame(out, columns=[id_col, "clean_text", "removed"])

    return pairs.mapInPandas(run, f"`{id_col}` long, clean_text string, removed long")
