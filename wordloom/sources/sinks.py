"""Sinks and their sources: JSON lines, embeddings with their keys, coding sheets filled from a JSON state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_line(columns: list[str]) -> Column:
    """The columns as one JSON document; null fields are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document a line, in as many files as there are tasks."""
    df.select(json_line(df.columns).alias("value")).write.mode(mode).text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON of the schema give nulls, and the line itself in ``_corrupt_record`` if the schema has it."""
    return spark.read.schema(schema).json(path)


def write_embeddings(df: DataFrame, path: str, key: str, vector: str, mode: str = "errorifexists") -> None:
    """key and vector as array<float>; rows are found by key, never by their order. A repeated key is refused."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")
    df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).write.mode(mode).parquet(path)


def read_embeddings(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the vector of their key, null where there is none."""
    return rows.join(spark.read.parquet(path).withColumnRenamed("key", key), key, "left")


def fill_from_state(template: DataFrame, state: DataFrame, key: str, json: str, fields: dict[str, str]) -> DataFrame:
    """key, the fields and ``complete``: the template's rows with what their JSON document holds; lists are joined by ``|``.

    A row without a document, or with a null in a field, isn't complete.  A repeated key of the state takes its greatest document.
    """
    parsed = state.groupBy(key).agg(F.max(json).alias("j")).select(key, F.from_json("j", ", ".join(f"`{n}` {t}" for n, t in fields.items())).alias("s"))
    x = template.join(parsed, key, "left")
    value = {n: F.array_join(f"s.{n}", "|") if t.startswith("array") else F.col(f"s.{n}") for n, t in fields.items()}
    complete = F.lit(True)
    for n in fields:
        complete = complete & F.col(f"s.{n}").isNotNull()
    return x.select(*template.columns, *[v.alias(n) for n, v in value.items()], complete.alias("complete"))


def completeness_gate(filled: DataFrame, partial: bool = False) -> DataFrame:
    """The filled rows; unless ``partial``, any that isn't complete is an error."""
    if not partial:
        missing = filled.where(~F.col("complete")).count()
        if missing:
            raise ValueError(f"{missing} rows are not complete")
    return filled.drop("complete")
