"""Relational building blocks: scans, writes as joins, predicates, joins and windows over DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, conditions: Mapping[str, object] | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Equality conjuncts (pushed to the scan), and the first ``limit`` rows in ``order``."""
    for name, value in (conditions or {}).items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    if limit is None:
        return df
    return (df.orderBy(*order) if order else df).limit(limit)


def multi_get(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    return df.filter(F.col(key).isin(list(ids)))


def next_number(df: DataFrame, col: str, pattern: str = r"(\d+)$") -> DataFrame:
    """One row: the number behind the largest numeric suffix."""
    return df.agg((F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({col}, r'{pattern}', 1) AS bigint)")), F.lit(0)) + 1).alias("next_id"))


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those rows whose keys it does not have; of rows with equal keys one."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """target with rows put over it; in ``keep_old`` columns a null does not replace a value. rows have unique keys."""
    columns = [c for c in target.columns if c not in keys]
    new = rows.select(*keys, *(F.col(c).alias(f"new {c}") for c in columns), F.lit(True).alias("new "))
    old = target.withColumn("old ", F.lit(True))
    joined = old.join(new, list(keys), "full_outer")
    pick = lambda c: F.coalesce(f"new {c}", c) if c in keep_old else F.when(F.col("new "), F.col(f"new {c}")).otherwise(F.col(c))
    return joined.select(*keys, *(pick(c).alias(c) for c in columns))


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All sources under each other, with their names; missing columns are null."""
    named = [df.withColumn("origin", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def duration_seconds(c: Column | str) -> Column:
    """Seconds of H:MM:SS or M:SS; 0 for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    part = F.transform(F.split(c, ":"), lambda x: x.try_cast("int"))
    at = lambda i: F.get(part, F.lit(i))
    return F.when(c.rlike(r"^\d+:\d{2}:\d{2}$"), at(0) * 3600 + at(1) * 60 + at(2)).when(c.rlike(r"^\d+:\d{2}$"), at(0) * 60 + at(1)).otherwise(0)


def format_duration(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


#: Rows of a side that may be sent to all tasks.
SEND_ROWS = 10_000


def sent_if_small(df: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """df, broadcast if a count finds ``most`` rows at most; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contains_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Some term in some column, whatever the case."""
    return reduce(or_, (F.contains(F.lower(F.col(c)), F.lit(t.lower())) for c in columns for t in terms), F.lit(False))


def like_any(column: str, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    c = F.col(column)
    return reduce(or_, (c.ilike(p) if ignore_case else c.like(p) for p in patterns), F.lit(False))


def compact(c: Column) -> Column:
    """Lower case, without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def collapse(c: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def tier(c: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that c does not exceed."""
    out = F
    for bound, label in bounds:
        out = out.when(c <= bound, label)
    return out.otherwise(otherwise)


def safe_percent(a: Column, b: Column, digits: int = 1) -> Column:
    """100 a / b, rounded; null where b is 0."""
    return F.round(a.cast("decimal(20,4)") / F.nullif(b, F.lit(0)).cast("decimal(20,4)") * 100, digits).cast("double")


def first_filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def keep_if_none(df: DataFrame, group: str, predicate: Column) -> DataFrame:
    """Rows that fit; all rows of a group in which none does. Groups are aggregated and joined: none is one task's."""
    marked = df.withColumn("fit ", F.coalesce(predicate, F.lit(False)))
    some = marked.groupBy(F.col(group).alias("group ")).agg(F.max("fit ").alias("some "))
    return marked.join(some, F.col(group).eqNullSafe(F.col("group "))).filter(F.col("fit ") | ~F.col("some ")).drop("fit ", "some ", "group ")


def floor_but_one(df: DataFrame, group: str, score: str, least: float, tie: str) -> DataFrame:
    """Rows of ``least`` or more, and the best one of a group that has none."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank ", F.row_number().over(w)).filter((F.col(score) >= least) | (F.col("rank ") == 1)).drop("rank ")


def recontacted(df: DataFrame, keys: Sequence[str], day: str, within: int = 7) -> Column:
    """True if the same keys come again 1 to ``within`` days later: a range frame, one shuffle, no self-join."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(number).rangeBetween(1, within)) > 0


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def ranked(df: DataFrame, order: Sequence, rank: str = "rank") -> DataFrame:
    """1..n over all rows of an aggregate."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that is set on the context; only a local session makes one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def in_order(df: DataFrame, order: Sequence) -> DataFrame:
    """df sorted over all its range partitions, with its partition ``p `` and its place in it, ``i ``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at ", F.monotonically_increasing_id()))
    return at.withColumns({"p ": F.shiftright("at ", 33), "i ": F.col("at ").bitwiseAND((1 << 33) - 1)}).drop("at ")


def offsets(at: DataFrame, value: Column) -> DataFrame:
    """``before ``, the sum of a value over earlier partitions: a row for each partition, which is all that one task sees."""
    sums = at.groupBy("p ").agg(F.sum(value).alias("s "))
    return F.broadcast(sums.select("p ", F.coalesce(F.sum("s ").over(Window.orderBy("p ").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before ")))


def numbered(df: DataFrame, order: Sequence, name: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """1..n in order, over all rows or within groups, of tables of any size: places in range partitions plus offsets.

    No partition holds a whole group, however few groups there are; ``order`` should tell all rows apart.
    """
    at = in_order(df, [*map(F.col, group), *order])
    out = at.join(offsets(at, F.lit(1)), "p ").withColumn(name, F.col("before ") + F.col("i ") + 1).drop("p ", "i ", "before ")
    if group:
        first = out.groupBy(*(F.col(g).alias(f"{g} ") for g in group)).agg((F.min(name) - 1).alias("first "))
        out = out.join(first, [F.col(g).eqNullSafe(F.col(f"{g} ")) for g in group]).withColumn(name, F.col(name) - F.col("first ")).drop("first ", *(f"{g} " for g in group))
    return out


def running_before(df: DataFrame, order: Sequence, value: str, name: str) -> DataFrame:
    """The sum of a value over all earlier rows: sums within range partitions plus offsets."""
    at = in_order(df, order)
    w = Window.partitionBy("p ").orderBy("i ").rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(offsets(at, F.col(value)), "p ")
    return out.withColumn(name, F.col("before ") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("p ", "i ", "before ")


#: Ranks that the marks around a percentile may be off by: this part of a group's rows.
ACCURACY = 10_000


def percentiles(df: DataFrame, group: str, value: str, at: Mapping[str, float]) -> DataFrame:
    """Exact interpolated percentiles by group, as named columns; nulls do not count.

    Approximate marks on both sides of each place, whose ranks are known to be off by one in ACCURACY at most, come from
    one aggregation. A second scan counts what is below the lower mark, and the values between the marks, equal ones
    together: the two values at the place are among those few. No rows are sorted, and no task sees a whole group, but
    for groups of under 10 * ACCURACY rows.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g "), F.col(value).alias("v "))
    ask = [p for x in at.values() for p in (max(0.0, x - 2 / ACCURACY), min(1.0, x + 2 / ACCURACY))]
    marks = rows.groupBy("g ").agg(F.count("*").alias("n "), F.percentile_approx("v ", ask, ACCURACY).alias("m "))
    few = F.col("n ") <= 10 * ACCURACY
    place = lambda p: (F.col("n ") - 1) * F.lit(p)
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.when(~few, F.get("m ", F.lit(2 * i))).alias("lo"), F.when(~few, F.get("m ", F.lit(2 * i + 1))).alias("hi"), place(p).alias("place")) for i, (k, p) in enumerate(at.items())))
    marks = marks.select(F.col("g ").alias("of "), F.inline(sides))
    met = rows.join(marks, F.col("g ").eqNullSafe(F.col("of ")))
    below = met.filter(F.col("v ") < F.col("lo")).groupBy(F.col("g ").alias("b "), F.col("k").alias("kb ")).agg(F.count("*").alias("below "))
    inside = met.filter((F.col("lo").isNull() | (F.col("v ") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v ") <= F.col("hi"))))
    inside = inside.groupBy("g ", "k", "v ", "place").agg(F.count("*").alias("c ")).join(below, F.col("g ").eqNullSafe(F.col("b ")) & (F.col("k") == F.col("kb ")), "left")
    end = F.coalesce("below ", F.lit(0)) + F.sum("c ").over(Window.partitionBy("g ", "k").orderBy("v "))
    first = F.floor("place")
    there = lambda i: (i >= F.col("end ") - F.col("c ")) & (i < F.col("end "))
    part = F.when(there(first), 1 - (F.col("place") - first)).otherwise(0.0) + F.when(there(first + 1), F.col("place") - first).otherwise(0.0)
    found = inside.withColumn("end ", end).withColumn("part ", part).filter("`part ` > 0")
    return found.groupBy(F.col("g ").alias(group)).agg(*(F.sum(F.when(F.col("k") == k, F.col("part ") * F.col("v "))).alias(k) for k in at))


def ntile(rank: Column, n: Column, tiles: int) -> Column:
    """The tile of a rank among n rows: the first n % tiles of them have one row more."""
    size, more = F.floor(n / tiles), n % tiles
    return F.when(rank <= more * (size + 1), F.ceil(rank / (size + 1))).otherwise(more + F.ceil((rank - more * (size + 1)) / size))


def trend(this: Column, last: Column, band: float = 0.05) -> Column:
    """up, down or same, by a band around last period's rate; something after nothing is up."""
    return F.when((last == 0) & (this > 0), "up").when(this > last * (1 + band), "up").when(this < last * (1 - band), "down").otherwise("same")


def islands(df: DataFrame, group: Sequence[str], order: Sequence, value: str, name: str = "island") -> DataFrame:
    """Number runs of equal values in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("changed ", changed).withColumn(name, F.sum("changed ").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed ")


def bounded(df: DataFrame, group: Sequence[str], order: Sequence, size: Column, budget: int) -> DataFrame:
    """The rows whose sizes, summed in order, stay within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used ", F.sum(size).over(w)).filter(F.col("used ") <= budget).drop("used ")


def check(name: str, df: DataFrame, actual: Column, low: float, high: float) -> DataFrame:
    """One row: check, actual, passed."""
    return df.agg(actual.cast("double").alias("actual")).select(F.lit(name).alias("check"), F.round("actual", 4).alias("actual"), F.col("actual").between(low, high).alias("passed"))
