"""How often every distinct value or term occurs, kept up to date by signed deltas.

Only records that were added, changed or deleted are read: each gives plus or minus its terms, the changes are summed
per term inside the Python workers and again in the shuffle, written as an immutable delta, and merged into the
persistent counts.  No term is dropped or sampled, and a hot term is one row per task by the time it is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.storage import read_manifest, remove, scratch_path, write_manifest

COUNTS = "field string, term string, occurrences long, records long"
_RUN = re.compile(r"\w+")
_TERM = re.compile(r"[a-z]{3,}")


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores of the lower-cased text."""
    return _RUN.findall(text.lower())


def _partial(field: str, tokenized: bool, flush_at: int):
    """Sum a task's changes by term; at ``flush_at`` distinct terms the sums so far are sent on, so memory stays bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        rows: Counter = Counter()
        total = 0

        def sums() -> pd.DataFrame:
            terms = [t for t in seen if not tokenized or _TERM.fullmatch(t)]
            return pd.DataFrame({"field": [field] * len(terms), "term": terms, "occurrences": [seen[t] for t in terms], "records": [rows[t] for t in terms]}).astype({"field": "object", "term": "object", "occurrences": "int64", "records": "int64"})

        for pdf in batches:
            for sign, part in pdf.groupby("sign"):
                values = part["value"].dropna().tolist()
                total += int(sign) * len(values)
                if tokenized:
                    occ: Counter = Counter()
                    docs: Counter = Counter()
                    for text in values:
                        found = terms_of(text)
                        occ.update(found)
                        docs.update(set(found))
                else:
                    occ = docs = Counter(values)
                add = seen.update if sign > 0 else seen.subtract
                add(occ)
                (rows.update if sign > 0 else rows.subtract)(docs)
            if len(seen) >= flush_at:
                yield sums()
                seen.clear()
                rows.clear()
        yield sums()
        yield pd.DataFrame({"field": [field], "term": [None], "occurrences": [total], "records": [total]}).astype({"term": "object"})

    return run


def partial_changes(changes: DataFrame, field: str, *, tokenized: bool, flush_at: int = 300_000) -> DataFrame:
    """Each task's per-term sums of ``changes`` (value, sign of +1 or -1); the row whose term is null has the number of records with a value."""
    return changes.mapInPandas(_partial(field, tokenized, flush_at), COUNTS)


class TermLedger:
    """Persistent counts below ``path``: immutable parts, each a signed change, partitioned by field and term bucket.

    ``apply`` takes the records added and removed (a changed record is both), reads only them and writes one part.  When
    there are ``merge_after`` parts, the newest are merged, and an older one joins them only if it is less than ``tier``
    times as large as they are, so the large counts aren't rewritten for small changes.  Terms whose counts fall to zero
    vanish when the oldest part is merged, and are never reported.  The state is in the newest manifest below ``path``;
    ``open`` takes a ledger up again, in any session.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, merge_after: int = 8, tier: int = 4, buckets: int = 16):
        self.spark, self.path = spark, (path or scratch_path(spark, "term-ledger")).rstrip("/")
        if read_manifest(spark, self.path):
            raise ValueError(f"there is a ledger at {self.path}; open it")
        self.merge_after, self.tier, self.buckets = merge_after, tier, buckets
        self.parts: list[dict] = []  # name and rows, the oldest first
        self._made = self._version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermLedger:
        found = read_manifest(spark, path.rstrip("/"))
        if not found:
            raise FileNotFoundError(f"there is no ledger at {path}")
        ledger = cls.__new__(cls)
        ledger.spark, ledger.path = spark, path.rstrip("/")
        ledger._version, state = found
        ledger.__dict__.update(state)
        return ledger

    def _commit(self) -> None:
        self._version += 1
        write_manifest(self.spark, self.path, self._version, {k: self.__dict__[k] for k in ("merge_after", "tier", "buckets", "parts", "_made")})

    def _write(self, df: DataFrame) -> dict:
        self._made += 1
        name = f"part={self._made:05d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy("field", "bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "rows": self._read([name]).count()}

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{COUNTS}, bucket int, part string").option("basePath", self.path).parquet(*(f"{self.path}/{n}" for n in names)).drop("part")

    def _summed(self, df: DataFrame) -> DataFrame:
        return df.groupBy("field", "bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    def apply(self, field: str, *, added: DataFrame | None = None, removed: DataFrame | None = None, value: str, tokenized: bool) -> None:
        sides = [df.select(F.col(f"`{value}`").cast("string").alias("value"), F.lit(sign).alias("sign")) for df, sign in ((added, 1), (removed, -1)) if df is not None]
        if not sides:
            return
        changes = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        # summed in the workers, so each term is one row a task; a bucket is one file
        sums = partial_changes(changes, field, tokenized=tokenized).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        self.parts.append(self._write(self._summed(sums.repartition("field", "bucket"))))
        old: list[dict] = []
        if len(self.parts) >= self.merge_after:
            k = len(self.parts) - 1
            rows = self.parts[k]["rows"]
            while k and (len(self.parts) - k < 2 or self.parts[k - 1]["rows"] < self.tier * rows):
                k -= 1
                rows += self.parts[k]["rows"]
            old = self.parts[k:]
            merged = self._summed(self._read([p["name"] for p in old]).repartition("field", "bucket"))
            self.parts[k:] = [self._write(merged.where("occurrences != 0 OR records != 0") if k == 0 else merged)]
        self._commit()
        for p in old:
            remove(self.spark, f"{self.path}/{p['name']}")

    def counts(self, keep_totals: bool = False) -> DataFrame:
        """field, term, occurrences, records over all that was applied."""
        if not self.parts:
            return self.spark.createDataFrame([], COUNTS)
        df = self._read([p["name"] for p in self.parts])
        if len(self.parts) > 1:
            df = self._summed(df)
        df = df.select("field", "term", "occurrences", "records").where(F.col("term").isNull() | (F.col("records") != 0))
        return df if keep_totals else df.where(F.col("term").isNotNull())

    def totals(self) -> DataFrame:
        """field, total: records that have a value."""
        df = self._read([p["name"] for p in self.parts]) if self.parts else self.spark.createDataFrame([], COUNTS)
        return df.where(F.col("term").isNull()).groupBy("field").agg(F.sum("records").alias("total"))


def marked_terms(ledger: TermLedger, rules: dict[str, tuple[int, int]], common_share: float = 0.25) -> DataFrame:
    """field, term, occurrences, records, mark (``rare``, ``common`` or null).

    ``rules``: of each field the fewest records and the fewest occurrences that aren't rare; rare goes before common,
    which is a share of the records with a value above ``common_share``.  Null values are no term; an empty string in a
    field that isn't tokenized is one.  Repeated records all count.  An empty ledger gives an empty table.
    """
    counts = ledger.counts().join(F.broadcast(ledger.totals()), "field")  # one row a field
    rare = F.lit(False)
    for field, (records, occurrences) in rules.items():
        rare = rare | ((F.col("field") == field) & ((F.col("records") < records) | (F.col("occurrences") < occurrences)))
    mark = F.when(rare, "rare").when(F.col("records") > F.col("total") * common_share, "common")
    return counts.select("field", "term", "occurrences", "records", mark.alias("mark"))
