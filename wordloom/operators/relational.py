"""Deduplication, merging, stratification and sampling.

Nulls in keys equal each other where rows are deduplicated; joins drop them. Ties are broken by the columns given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.storage import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 1, in ``order``, which should be total.

    No window over all rows: the rows are sorted by range and written, counted by range, and a row's place is the rows of
    the ranges before it and its own within its range.  The driver sees one count for each range.
    """
    at = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in at.groupBy(part).count().collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "__part long, __before long")  # one row a range
    own = at.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return own.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", "__at")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_provenance(df: DataFrame, key: str, provenance: str, order: str, others: list[str]) -> DataFrame:
    """One row of each non-null key: all provenances sorted and joined by ``|``, the first non-null value of each other column."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_set(provenance)), "|").alias(provenance), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])
    )


def rate_by(df: DataFrame, group: str, flag: Column) -> DataFrame:
    f = flag.cast("int")
    return df.groupBy(group).agg(F.sum(f).alias("hits"), F.count(F.lit(1)).alias("rows"), F.round(F.avg(f), 4).alias("rate"))


def cut_counts(df: DataFrame, ts: str, cut: str) -> DataFrame:
    """Rows before and from ``cut`` on, rows without a time, and the first and last time."""
    c = F.col(ts)
    at = F.lit(cut).cast("timestamp")
    return df.agg(F.count_if(c < at).alias("pre"), F.count_if(c >= at).alias("post"), F.count_if(c.isNull()).alias("untimed"), F.min(c).alias("first_ts"), F.max(c).alias("last_ts"))


def strata(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts along every dimension in one pass."""
    s = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("s")
    return df.select(s).groupBy("s.dim", "s.value").agg(F.count(F.lit(1)).alias("rows"))


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")))


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: str = "42") -> DataFrame:
    """At most ``k`` rows of each group, those of the least md5 of seed and key."""
    return keep_first_k(df, [group], [hash_order(key, seed), F.col(key)], k)


def keep_first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows, of each stratum its share but at least one, topped up from the rest; order by md5 instead of a generator.

    No stratum can give more than its first ``n`` rows, so these are cut out first: a limit that each task applies
    before the shuffle, whatever a stratum's size.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__g"))
    total = F.sum("__g").over(Window.partitionBy())
    quota = sizes.select(F.col(stratum).alias("__s"), F.greatest(F.lit(1), F.floor(F.least(F.lit(n), total) * F.col("__g") / total)).alias("__q"))
    w = Window.partitionBy(stratum).orderBy("__h", key)
    ranked = df.withColumn("__h", hash_order(key, seed)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    joined = ranked.join(quota, ranked[stratum].eqNullSafe(quota["__s"]))
    return joined.orderBy((F.col("__r") > F.col("__q")).cast("int"), "__h", key).limit(n).select(*df.columns)


def value_at_half(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, upper_median, least, most: the value at rank n // 2 + 1 of each group, exactly; null values don't count.

    Ranks come from the counts of the distinct values, split by ranges of values, so no group is sorted in one task: the
    range that holds the rank is found from one count a range, and only its values are looked at.
    """
    counted = materialize(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c")), "value-counts")
    bounds = counted.groupBy(group).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile_approx(value, [i / 64 for i in range(1, 64)], 200).alias("cuts"))
    b = materialize(bounds, "value-bounds")  # one row a group
    cell = F.size(F.filter("cuts", lambda x: x < F.col(value)))
    placed = counted.join(b.select(F.col(group).alias("__g"), "cuts"), F.col(group).eqNullSafe(F.col("__g"))).select(group, value, "c", cell.alias("cell"))
    cells = placed.groupBy(group, "cell").agg(F.sum("c").alias("in_cell"))  # at most 64 a group
    own = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(own), F.lit(0)))
    want = F.floor(F.col("n") / 2) + 1
    hit = cells.join(b.select(F.col(group).alias("__g"), "n"), F.col(group).eqNullSafe(F.col("__g"))).where((F.col("before") < want) & (F.col("before") + F.col("in_cell") >= want)).select("__g", F.col("cell").alias("__c"), "before", want.alias("want"))
    near = placed.join(F.broadcast(hit), F.col(group).eqNullSafe(F.col("__g")) & (F.col("cell") == F.col("__c")))
    run = F.sum("c").over(Window.partitionBy(group).orderBy(value))
    found = near.withColumn("run", run + F.col("before")).where(F.col("run") >= F.col("want")).groupBy(group).agg(F.min(value).alias("upper_median"))
    f = found.select(F.col(group).alias("__g"), "upper_median")
    return b.join(f, F.col(group).eqNullSafe(F.col("__g"))).select(group, "upper_median", "least", "most")


def lookup(df: DataFrame, known: DataFrame, key: str, order: str, fields: list[str], default: str = "unknown") -> DataFrame:
    """Add ``fields`` of the row of ``known`` with the same key, the last in ``order``; without one, ``default``. Null keys find nothing."""
    last = known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(*[F.max_by(c, order).alias(f"__{c}") for c in fields])
    x = df.join(last, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(F.col(f"__{c}").cast("string"), F.lit(default)) for c in fields})
    return x.drop("__k", *[f"__{c}" for c in fields])


def change_flags(new: DataFrame, old: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """``new`` rows whose key is in ``old``, with ``<field>_changed`` yes or no against the last old row in ``order``; two nulls are no change."""
    last = old.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(*[F.max_by(c, order).alias(f"__{c}") for c in fields])
    x = new.join(last, F.col(key) == F.col("__k"))
    return x.withColumns({f"{c}_changed": F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), "no").otherwise("yes") for c in fields}).drop("__k", *[f"__{c}" for c in fields])


def routed(df: DataFrame, depends: dict[str, str], exclusive: tuple[str, str] | None = None) -> DataFrame:
    """Fields of ``depends`` become null where the field they depend on is; ``valid``: the exclusive value of a list field stands alone or not at all."""
    x = df.withColumns({f: F.when(F.col(on).isNotNull(), F.col(f)) for f, on in depends.items()})
    if not exclusive:
        return x.withColumn("valid", F.lit(True))
    field, value = exclusive
    return x.withColumn("valid", ~F.coalesce(F.array_contains(field, value) & (F.size(field) > 1), F.lit(False)))
