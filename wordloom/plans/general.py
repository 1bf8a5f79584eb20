"""Queries of the two general training-data problems: timestamps and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.redelivery import redelivered
from wordloom.operators.timestamps import normalize_timestamps
from wordloom.plans.catalog import Catalog, table

catalog = Catalog()
STAMPED = ("lcr_pass1b_canonical", "memory_lcr_candidates")


@catalog.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "feed_sources")
    parts = [
        normalize_timestamps(table(spark, sf_dir, name).select("row_id", "createdAt", "source"), feeds)
        .where(F.col("utc_us").isNotNull() & ~F.col("utc_us_plain"))
        .select(F.lit(name).alias("src"), F.col("row_id").cast("long").alias("row_id"), "utc_us")
        for name in STAMPED
    ]
    return parts[0].unionByName(parts[1])


@catalog.add(
    "p2_found",
    """
    WITH m AS (
      SELECT row_id, coalesce(ingested_at, TIMESTAMP '9999-12-31 00:00:00') AS arrived,
             nullif(regexp_replace(lower(trim(comment_id)), '^t1_', ''), '') AS c,
             nullif(regexp_replace(lower(trim(post_id)), '^t3_', ''), '') AS p
      FROM lcr_pass1b_canonical),
    k AS (SELECT row_id, arrived, CASE WHEN c IS NOT NULL THEN 'c:' || c ELSE 'p:' || p END AS key FROM m)
    SELECT row_id FROM (
      SELECT row_id, row_number() OVER (PARTITION BY key ORDER BY arrived, row_id) AS n FROM k WHERE key IS NOT NULL)
    WHERE n > 1
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(table(spark, sf_dir, "lcr_pass1b_canonical").select("row_id", "post_id", "comment_id", "ingested_at"))
