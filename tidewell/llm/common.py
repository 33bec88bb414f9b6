"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given ones; from then on, texts go to Python in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python: by default Spark counts to 64 MB, for each task twice over.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of 4 MB (and one row more) in this session, unless it has a setting of its own."""
    if spark.conf.get(BATCH, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(BATCH, "4m")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that is set on the context; only a local session makes one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's shared folder: lineage is cut, and columns can be read one by one."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def screen_of(keys: DataFrame, mask: int):
    """A bitmap of the bigint column ``key``, as a broadcast variable of mask + 1 bits whatever their number; where it fills up, it only screens less."""
    bit = F.col("key").bitwiseAND(mask)
    words = keys.select(F.shiftright(bit, 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    screen = np.zeros((mask + 1) // 32, dtype="<u4")
    screen[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(screen.view(np.uint8))


def named(name: str) -> Column:
    """The column of just that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
