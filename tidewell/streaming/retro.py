"""Tables that a stream updates behind itself: a later contact reopens earlier ones of the same customer and category.

The table is dealt to a fixed number of parts by customer, so that all rows which a batch may change are in the parts of
its customers. A batch reads and rewrites only those parts, each as a new version; a reader takes each part's last
version, and a batch that is run again writes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewell.operators.relational import recontacted

#: Parts of a table: as many small folders as a batch may have to rewrite.
PARTS = 64


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Each part's last version, or the last before a batch; a row for each part and version is read, no data."""
    try:
        seen = spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return {}
    seen = seen if before is None else seen.filter(F.col("batch") < before)
    return {r["part"]: r["batch"] for r in seen.groupBy("part").agg(F.max("batch").alias("batch")).collect()}


def current(spark: SparkSession, path: str, schema: str, parts: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of some parts (by default all) in their last versions; only those folders are read."""
    last = {p: b for p, b in versions(spark, path, before).items() if parts is None or p in parts}
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/part={p}/batch={b}" for p, b in sorted(last.items())))


def retro_sink(path: str, schema: str, customer: str, build: Callable[[DataFrame], DataFrame], key: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows join those of the parts that it touches, and ``build`` makes the new versions.

    ``schema`` is that of the incoming rows, of which the one that came last stands for its ``key``; ``build`` adds
    columns. What it gives must only depend on rows of one customer.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(customer), F.lit(parts)).cast("int")
        rows = batch.select([f.name for f in spark.createDataFrame([], schema).schema]).withColumn("part", part)
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS at most
        if not touched:
            return
        old = current(spark, path, schema, touched, number).join(rows.select(key).distinct(), key, "left_anti").withColumn("part", part)
        new = build(old.unionByName(rows.dropDuplicates([key])))
        new.withColumn("batch", F.lit(number)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)

    return write


def reopened(rows: DataFrame, within: int = 7) -> DataFrame:
    """resolved: whether no contact of the same customer and category follows 1 to ``within`` days later."""
    return rows.withColumn("resolved", ~recontacted(rows, ["customer", "category"], "day", within))


def counters(contacts: DataFrame) -> DataFrame:
    """The counters of customers that follow from their contacts: total, resolved at first, last day."""
    return contacts.groupBy("customer").agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved_first"), F.max("day").alias("last_day"))
