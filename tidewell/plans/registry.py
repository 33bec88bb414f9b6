"""Registered queries: a Spark function of (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The day that relative periods end on.
AS_OF = "2024-01-31"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def as_of():
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as contact records: one call of a customer about a category, with a MM:SS duration."""
    e = table(spark, sf_dir, "events")
    seconds = F.col("value").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("customer"),
        F.col("event_type").alias("category"),
        "ts",
        F.to_date("ts").alias("day"),
        F.format_string("%d:%02d", F.expr("cast(value as int) div 60"), seconds % 60).alias("duration"),
        "value",
        "props",
    )


CONTACTS = """contacts AS (SELECT event_id AS id, user_id AS customer, event_type AS category, ts, CAST(ts AS DATE) AS day,
  CAST(CAST(trunc(value) AS INT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(trunc(value) AS INT) % 60 AS VARCHAR), 2, '0') AS duration, value, props FROM events)"""
