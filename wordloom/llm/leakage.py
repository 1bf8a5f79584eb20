"""Evaluation passages inside training texts: an FM-index per shard of documents, searched backwards.

A shard holds the words of some documents as one integer text over its own list of words: its Burrows-Wheeler transform, every
8th suffix position, and where each document begins.  ``ShardIndex`` keeps the shards of a corpus as a table, so that any
later set of items is searched in it without reading the corpus again.  All phrases of ``n`` words step backwards together
through the ranks of a wavelet tree; hits are located by walking to a sampled position, and hits of a document that
overlap are merged into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.storage import read_manifest, scratch_path, write_manifest

_WORD = re.compile(r"[^\W_]+")
SHARD = "words array<string>, bwt binary, rows binary, docs array<long>, starts array<int>, offsets array<long>"
SPANS = "doc long, item_id long, from_word long, to_word long"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by prefix doubling; the last symbol is the least and stands once."""
    n = len(s)
    rank, width = s.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of an integer text over symbols 1..; 0 ends it."""

    def __init__(self, bwt: np.ndarray, sampled: np.ndarray, sample: int = 8):
        """``bwt``: the transform; ``sampled``: the positions that are multiples of ``sample``, in order of their suffixes."""
        self.bwt, n = bwt.astype(np.int32), len(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt))])
        self.bits = max(1, int(self.bwt.max()).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        seq = self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.levels.append((np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32), int((bit == 0).sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        # rows whose suffix has a sampled position: position + 1, else 0
        self.position = np.zeros(n, np.int32)
        self.position[sampled[0]] = sampled[1] + 1

    @classmethod
    def of(cls, text: np.ndarray, sample: int = 8) -> FMIndex:
        return cls(*cls.state(text, sample), sample)

    @staticmethod
    def state(text: np.ndarray, sample: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The transform, and rows and positions of the sampled suffixes."""
        s = np.concatenate([text.astype(np.int64), [0]])
        order = _suffix_order(s)
        at = np.flatnonzero(order % sample == 0)
        return s[order - 1].astype(np.int32), np.stack([at, order[at]]).astype(np.int32)

    def occ(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before row ``before``."""
        low, high = np.zeros_like(before), before.copy()
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            l1, h1 = ones[low], ones[high]
            low, high = np.where(bit == 1, zeros + l1, low - l1), np.where(bit == 1, zeros + h1, high - h1)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``phrases``."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        known = (phrases < len(self.first) - 1).all(axis=1)
        high[~known] = 0
        for c in phrases.T[::-1]:
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            x = c[alive]
            low[alive], high[alive] = self.first[x] + self.occ(x, low[alive]), self.first[x] + self.occ(x, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, out = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = self.position[at[left]]
            hit = here > 0
            out[left[hit]] = here[hit] - 1 + steps
            left = left[~hit]
            x = self.bwt[at[left]]
            at[left] = self.first[x] + self.occ(x, at[left])
            steps += 1
        return out



def _shards(shard_words: int, overlap: int):
    """Close a shard at ``shard_words`` words; a longer document is cut, with ``overlap`` words in both cuts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code: dict[str, int] = {}
        stream: list[int] = []
        docs: list[int] = []
        starts: list[int] = []
        offsets: list[int] = []

        def close() -> pd.DataFrame:
            bwt, rows = FMIndex.state(np.array(stream, dtype=np.int64))
            return pd.DataFrame({"words": [list(code)], "bwt": [bwt.tobytes()], "rows": [rows.tobytes()], "docs": [list(docs)], "starts": [list(starts)], "offsets": [list(offsets)]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                w = words_of(t or "")
                for at in range(0, len(w), shard_words):
                    part = w[at : at + shard_words + overlap]
                    if at and len(part) <= overlap:
                        break  # all of it stands in the cut before
                    docs.append(i)
                    starts.append(len(stream))
                    offsets.append(at)
                    stream += [code.setdefault(x, len(code) + 2) for x in part]
                    stream.append(1)  # ends the document
                    if len(stream) >= shard_words:
                        yield close()
                        for x in (code, stream, docs, starts, offsets):
                            x.clear()
        if stream:
            yield close()

    return run


class ShardIndex:
    """FM-index shards of a corpus below ``path``, built once and opened again for any set of items.

    ``shard_words``: words of a shard; ``overlap``: the longest phrase that is found across the cuts of a document longer than a
    shard, less one; ``item_block``: items that are sent to the workers at once, more are searched block by block.
    """

    def __init__(self, spark: SparkSession, path: str, overlap: int):
        self.spark, self.path, self.overlap = spark, path, overlap

    @classmethod
    def build(cls, df: DataFrame, path: str | None = None, *, text: str = "text", id_col: str = "doc_id", shard_words: int = 400_000, overlap: int = 99, shards_per_file: int = 8) -> ShardIndex:
        spark = df.sparkSession
        path = (path or scratch_path(spark, "fm-shards")).rstrip("/")
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
        # few shards a file, so that a task that searches never holds many
        rows.mapInPandas(_shards(shard_words, overlap), SHARD).write.option("maxRecordsPerFile", shards_per_file).parquet(f"{path}/shards")
        write_manifest(spark, path, 1, {"overlap": overlap})
        return cls(spark, path, overlap)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ShardIndex:
        found = read_manifest(spark, path.rstrip("/"))
        if not found:
            raise FileNotFoundError(f"there is no index at {path}")
        return cls(spark, path.rstrip("/"), found[1]["overlap"])

    def search(self, items: DataFrame, *, n: int = 12, item_text: str = "text", item_id: str = "item_id", item_block: int = 50_000) -> DataFrame:
        """doc, item_id, from_word, to_word: the merged spans of a document that share ``n`` or more words with an item."""
        if n > self.overlap + 1:
            raise ValueError(f"the index was built for phrases of at most {self.overlap + 1} words")
        found = items.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
        count = found.count()
        blocks = -(-count // item_block)
        shards = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards")
        hits = None
        for k in range(blocks):
            block = found if blocks == 1 else found.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
            part = shards.mapInPandas(_search([(r["i"], r["t"]) for r in block.toLocalIterator()], n), SPANS)
            hits = part if hits is None else hits.unionByName(part)
        if hits is None:
            return self.spark.createDataFrame([], SPANS)
        # spans of a document that was cut, or that stands in several shards, are merged once more
        own = Window.partitionBy("doc", "item_id").orderBy("from_word", "to_word")
        reach = F.max("to_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
        marked = hits.withColumn("new", F.coalesce((F.col("from_word") > reach).cast("int"), F.lit(1)))
        marked = marked.withColumn("g", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy("doc", "item_id", "g").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word")).drop("g")


def _search(rows: list[tuple[int, str]], n: int):
    phrases: dict[tuple[str, ...], set[int]] = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - n + 1):
            phrases.setdefault(tuple(w[k : k + n]), set()).add(i)
    vocabulary = sorted({x for p in phrases for x in p})
    number = {x: i for i, x in enumerate(vocabulary)}
    matrix = np.array([[number[x] for x in p] for p in phrases], dtype=np.int64).reshape(-1, n)
    owners = [sorted(v) for v in phrases.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for words, bwt, rows, docs, starts, offsets in zip(*(pdf[c] for c in ("words", "bwt", "rows", "docs", "starts", "offsets"))):
                code = {x: i + 2 for i, x in enumerate(words)}
                symbol = np.array([code.get(x, 0) for x in vocabulary], dtype=np.int64)
                own = symbol[matrix] if len(matrix) else matrix
                able = np.flatnonzero((own > 0).all(axis=1))  # the others have a word that the shard hasn't
                spans: dict[str, list[int]] = {c: [] for c in ("doc", "item_id", "from_word", "to_word")}
                if len(able):
                    index = FMIndex(np.frombuffer(bwt, np.int32), np.frombuffer(rows, np.int32).reshape(2, -1))
                    low, high = index.search(own[able])
                    hit = np.flatnonzero(low < high)
                    if len(hit):
                        which = np.repeat(able[hit], high[hit] - low[hit])
                        at = index.locate(np.concatenate([np.arange(low[h], high[h]) for h in hit]))
                        part = np.searchsorted(starts, at, side="right") - 1
                        out: dict[tuple[int, int], set[int]] = {}
                        for p, a, r in zip(which, at, part):
                            for item in owners[p]:
                                out.setdefault((int(docs[r]), item), set()).add(int(a) - int(starts[r]) + int(offsets[r]))
                        for (doc, item), places in out.items():
                            begin = end = None
                            for a in [*sorted(places), None]:
                                if begin is not None and (a is None or a > end + n):
                                    for c, v in zip(spans, (doc, item, begin, end + n)):
                                        spans[c].append(v)
                                    begin = None
                                if a is not None:
                                    begin = a if begin is None else begin
                                    end = a
                yield pd.DataFrame(spans).astype("int64")

    return run


def leaked(df: DataFrame, items: DataFrame, *, n: int = 12, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", shard_words: int = 400_000, item_block: int = 50_000) -> DataFrame:
    """id_col, item_id, from_word, to_word: the merged spans of a document that share ``n`` or more words with an item.

    Null texts and texts of fewer than ``n`` words share nothing; rows that repeat an id are one document.  Builds an
    index for this one search; keep a ``ShardIndex`` to search the same corpus again.
    """
    index = ShardIndex.build(df, text=text, id_col=id_col, shard_words=shard_words, overlap=max(99, n - 1))
    return index.search(items, n=n, item_text=item_text, item_id=item_id, item_block=item_block).withColumnRenamed("doc", id_col)
