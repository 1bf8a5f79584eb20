"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "wordloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC clock, AQE with skew handling, Arrow batches small enough for long texts.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces from Spark's own figure.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return b.config(map=settings).getOrCreate()
