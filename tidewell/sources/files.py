"""Sources and sinks: CSV, JSON, text and binary files, and resumable appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import pack, sentences
from tidewell.operators.relational import numbered


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """path, section number, title and body of Markdown files with ``## `` headings."""
    parts = F.filter(F.split("text", r"(?m)^## "), lambda s: F.trim(s) != "")
    return read_texts(spark, path).select("path", F.posexplode(parts).alias("section", "part")).select("path", "section", F.regexp_extract("part", r"^([^\n]*)", 1).alias("title"), F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def load_chunks(spark: SparkSession, path: str, size: int, start: int = 0) -> DataFrame:
    """id, path, chunk, text of the text files of a folder, packed by sentences; ids run on from ``start`` by path and chunk."""
    chunks = read_texts(spark, path).select("path", F.posexplode(pack(sentences(F.col("text")), size)).alias("chunk", "text"))
    return numbered(chunks, [F.col("path"), F.col("chunk")], "id").select((F.col("id") + start).alias("id"), "path", "chunk", "text")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content: the input of a parser that is plugged in as a pandas UDF."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the table does not have; run again after a failure it adds nothing twice."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.dropDuplicates(list(keys)).write.parquet(path)
        return
    new = df.dropDuplicates(list(keys)).join(have.select(*keys), list(keys), "left_anti")
    new.write.mode("append").parquet(path)


def resume(df: DataFrame, path: str, progress: str, step: str, stop_after: int | None = None) -> None:
    """Append df step by step, the values of a column in their order, and note each that is done; steps noted are not done again.

    A step that was written but not noted, as the load stopped between, replaces what it has written.
    """
    spark = df.sparkSession
    try:
        done = {r[0] for r in spark.read.parquet(progress).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    for value in sorted(r[0] for r in df.select(step).distinct().collect() if r[0] not in done)[:stop_after]:
        df.filter(F.col(step) == F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).parquet(path)
        spark.createDataFrame([(value,)], df.select(step).schema).write.mode("append").parquet(progress)


def columns(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """name, column, kind, position of the columns of tables and views, as the session's catalog has them."""
    rows = [(t, c.name, c.dataType, i) for t in tables for i, c in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, "name string, column string, kind string, position int")


def catalog(spark: SparkSession) -> DataFrame:
    """Tables and views of the current database."""
    return spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()], "name string, kind string, temporary boolean")


__all__ = ["append_new", "catalog", "columns", "load_chunks", "read_binary", "read_csv", "read_json_array", "read_sections", "read_texts", "resume", "write_csv"]
