"""Exactly one copy of messages that were delivered at least once.

The known identifiers live in a persistent index: runs of identifier arrays, sorted within each hash prefix.
A batch is reduced to one row per identifier before anything is shuffled, each prefix is looked up in every run by
binary search, novel identifiers become a new immutable run, and runs are merged when they have become many.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.storage import materialize, read_manifest, remove, scratch_path, write_manifest

_RUN = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("prefix", T.IntegerType()), T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.LongType()))])


def message_key(comment_id: Column, post_id: Column) -> Column:
    """``c:`` or ``p:`` and the identifier without outer blanks, letter case and its ``t1_`` or ``t3_``; null without one."""
    clean = lambda c, kind: F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), f"^{kind}_", "")
    comment, post = clean(comment_id, "t1"), clean(post_id, "t3")
    return F.when(comment != "", F.concat(F.lit("c:"), comment)).when(post != "", F.concat(F.lit("p:"), post))


def _sorted_run(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", kind="stable")
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "prefix": [int(pdf["prefix"].iloc[0])], "ids": [pdf["key"].tolist()], "rows": [pdf["row"].tolist()]})


def _unseen(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch whose key stands in none of the sorted arrays of its prefix."""
    columns = ["part", "prefix", "key", "row"]
    if batch.empty:
        return batch[columns]
    keys = batch["key"].to_numpy(dtype=object)
    fresh = np.ones(len(keys), dtype=bool)
    for ids in runs["ids"]:
        arr = np.asarray(ids, dtype=object)
        at = np.searchsorted(arr, keys)
        hit = at < len(arr)
        hit[hit] = arr[at[hit]] == keys[hit]
        fresh &= ~hit
    return batch.loc[fresh, columns]


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = np.concatenate([np.asarray(x, dtype=object) for x in pdf["ids"]])
    rows = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["rows"]])
    order = np.argsort(ids, kind="stable")
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "prefix": [int(pdf["prefix"].iloc[0])], "ids": [ids[order].tolist()], "rows": [rows[order].tolist()]})


class DeliveryIndex:
    """Identifiers seen so far, as immutable sorted runs below ``path``.

    A run has one row for each hash prefix, and its files are partitioned by groups of prefixes (``parts``), so a
    batch reads the parts that its own prefixes fall into and no others.  ``merge_after``: this many runs are merged into
    one; if the identifiers have outgrown ``per_prefix`` in a prefix on average, the merge splits them over more
    prefixes.  The state is in the newest manifest below ``path``; ``open`` takes an index up again, in any session.
    One writer at a time: a second one fails when it writes its manifest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, prefixes: int = 64, merge_after: int = 8, parts: int = 16, per_prefix: int = 50_000):
        self.spark, self.path = spark, (path or scratch_path(spark, "delivery-index")).rstrip("/")
        if read_manifest(spark, self.path):
            raise ValueError(f"there is an index at {self.path}; open it")
        self.prefixes, self.merge_after, self.parts, self.per_prefix = 1 << max(0, prefixes - 1).bit_length(), merge_after, parts, per_prefix
        self.runs: list[dict] = []  # name, prefixes and number of ids
        self._made = self._version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DeliveryIndex:
        found = read_manifest(spark, path.rstrip("/"))
        if not found:
            raise FileNotFoundError(f"there is no index at {path}")
        index = cls.__new__(cls)
        index.spark, index.path = spark, path.rstrip("/")
        index._version, state = found
        index.__dict__.update(state)
        return index

    def _commit(self) -> None:
        self._version += 1
        write_manifest(self.spark, self.path, self._version, {k: self.__dict__[k] for k in ("prefixes", "merge_after", "parts", "per_prefix", "runs", "_made")})

    @staticmethod
    def prefixes_for(keys: int, per_prefix: int = 50_000) -> int:
        """A power of two, so that a split keeps what it needn't move."""
        return 1 << (max(8, -(-keys // per_prefix)) - 1).bit_length()

    def _placed(self, df: DataFrame, prefixes: int) -> DataFrame:
        prefix = F.pmod(F.xxhash64("key"), F.lit(prefixes)).cast("int")
        return df.select(F.pmod(prefix, F.lit(min(self.parts, prefixes))).alias("part"), prefix.alias("prefix"), "key", "row")

    def _read(self, parts: list[int] | None = None) -> DataFrame:
        base = self.spark.read.schema(_RUN).option("basePath", self.path)
        df = base.parquet(*(f"{self.path}/{r['name']}" for r in self.runs))
        return (df if parts is None else df.where(F.col("part").isin(parts))).select(*_RUN.names)

    def _write(self, df: DataFrame) -> dict:
        """``df``: part, prefix, ids, rows; clustered by part, so that a part is one file."""
        self._made += 1
        name = f"run={self._made:05d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy("part").parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}").agg(F.sum(F.size("rows"))).head()[0]
        return {"name": name, "ids": int(n or 0)}

    def add(self, batch: DataFrame) -> None:
        """``batch``: key, row and any ``order`` struct; the smallest order of a key is its copy. Null keys are left out."""
        one = batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("order").alias("o")).select("key", F.col("o.row").alias("row"))
        self.add_distinct(materialize(self._placed(one, self.prefixes), "delivery-batch"))

    def add_distinct(self, local: DataFrame) -> None:
        """As ``add``, for part, prefix, key and row of keys that are distinct already."""
        if self.runs:
            parts = [r["part"] for r in local.select("part").distinct().collect()]  # at most ``parts`` numbers
            local = local.groupBy("part", "prefix").cogroup(self._read(parts).groupBy("part", "prefix")).applyInPandas(_unseen, "part int, prefix int, key string, row long")
        run = self._write(local.repartition("part").groupBy("part", "prefix").applyInPandas(_sorted_run, _RUN))
        old: list[dict] = []
        if run["ids"]:
            self.runs.append(run)
        if len(self.runs) >= self.merge_after:
            old, self.runs = self.runs, [self._merged()]
        self._commit()
        for r in old:
            remove(self.spark, f"{self.path}/{r['name']}")

    def _merged(self) -> dict:
        want = self.prefixes_for(sum(r["ids"] for r in self.runs), self.per_prefix)
        if want <= self.prefixes:
            return self._write(self._read().repartition("part").groupBy("part", "prefix").applyInPandas(_merge, _RUN))
        flat = self._read().select(F.explode(F.arrays_zip("ids", "rows")).alias("x")).select(F.col("x.ids").alias("key"), F.col("x.rows").alias("row"))
        self.prefixes = want
        return self._write(self._placed(flat, want).repartition("part").groupBy("part", "prefix").applyInPandas(_sorted_run, _RUN))

    def winners(self) -> DataFrame:
        """The row that stands for each identifier: ``row``."""
        if not self.runs:
            return self.spark.createDataFrame([], "row long")
        return self._read().select(F.explode("rows").alias("row"))


def redelivered(
    df: DataFrame,
    *,
    post_id: str = "post_id",
    comment_id: str = "comment_id",
    row_id: str = "row_id",
    arrived: str = "ingested_at",
    batches: int = 4,
    index: DeliveryIndex | None = None,
) -> DataFrame:
    """``row_id`` of every superfluous copy of a message.

    The copy that arrived first stays, on a tie the one of the lowest ``row_id``; a null arrival counts as last.
    Rows without an identifier (null or blank ones) are never superfluous.  The table is replayed in order of
    arrival as ``batches`` deliveries, the cuts being quantiles of the arrival time; the result doesn't depend on
    the cuts.  An empty table gives an empty result.  ``row_id`` must be unique.  The table is read once for all
    deliveries: reduced to one row for each key and delivery and written, partitioned by delivery, so that each
    reads its own.  With an ``index`` that was opened, what it holds arrived before.
    """
    spark = df.sparkSession
    rows = df.select(
        message_key(F.col(f"`{comment_id}`"), F.col(f"`{post_id}`")).alias("key"),
        F.unix_micros(F.coalesce(F.col(f"`{arrived}`").cast("timestamp"), F.lit("9999-12-31 00:00:00").cast("timestamp"))).alias("at"),
        F.col(f"`{row_id}`").cast("long").alias("row"),
    ).where(F.col("key").isNotNull())
    shares = [i / batches for i in range(1, batches)]
    stats = rows.agg(F.approx_count_distinct("key").alias("n"), F.percentile_approx("at", shares or [0.5], 1000).alias("q")).head()
    cuts = sorted(set(stats["q"] or [])) if shares else []
    if index is None:
        index = DeliveryIndex(spark, prefixes=DeliveryIndex.prefixes_for(int(stats["n"] or 0)), merge_after=3)
    delivery = sum((F.col("at") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = scratch_path(spark, "deliveries")
    one = rows.withColumn("delivery", delivery).groupBy("key", "delivery").agg(F.min(F.struct("at", "row")).alias("o")).select("delivery", "key", F.col("o.row").alias("row"))
    one.write.partitionBy("delivery").parquet(path)
    staged = spark.read.schema("key string, row long, delivery int").parquet(path)
    for k in range(len(cuts) + 1):
        index.add_distinct(index._placed(staged.where(F.col("delivery") == k), index.prefixes))
    return rows.select(F.col("row").alias("row_id")).join(index.winners().select(F.col("row").alias("row_id")), "row_id", "left_anti")
