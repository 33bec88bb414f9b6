"""Exact deduplication of batches against immutable snapshots.

A snapshot is written once: the exact table of its distinct digests, and a static binary-fuse filter for each bucket of
them. What comes later is first grouped by digest (its own copies meet there, pre-aggregated map-side); the distinct
digests probe the filters of all earlier snapshots in their bucket, and only those that a filter lets through are joined
with that snapshot's exact table: a digest that is new meets no table. Until then nothing but digests has moved. Texts
follow for groups of two rows or more, which are compared byte by byte with the row that stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, named, partitions, read

#: Distinct digests that one bucket, and so one filter and one task group, is planned to hold.
BUCKET_KEYS = 50_000
#: Copies of one text that one salt of the byte check takes.
SALT_ROWS = 64

#: Groups of copies, at 60 bytes each, up to which their table is sent to all tasks; a larger one is shuffled.
SEND_ROWS = 100_000

FILTER_SCHEMA = "snapshot int, bucket int, seed long, segment int, segments int, slots binary"
SCREENED = "snapshot int, digest binary, keep {id}, n long, hit int"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over uint64 keys."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fuse_places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in consecutive segments, and its fingerprint byte."""
    h = mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    g = mix(h, seed + 1)
    offsets = [(g >> np.uint64(20 * i)) % np.uint64(segment) for i in range(3)]
    places = np.stack([(first + np.uint64(i)) * np.uint64(segment) + offsets[i] for i in range(3)], axis=1)
    return places.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, first segments, slots) of the binary-fuse filter over distinct keys.

    Peels every slot that one key alone uses, wave by wave; on a core that cannot be peeled the next seed is taken.
    """
    n = len(keys)
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    total = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    segments = max(1, -(-total // segment) - 2)
    for seed in range(1, 1000):
        places, prints = fuse_places(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)  # xor of the keys left in a slot
        for i in range(3):
            np.bitwise_xor.at(owner, places[:, i], np.arange(n))
        order, through, left = [], [], n
        single = np.flatnonzero(count == 1)
        while left and len(single):
            key, at = np.unique(owner[single], return_index=True)
            order.append(key)
            through.append(single[at])
            left -= len(key)
            touched = places[key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if not left:
            slots = np.zeros(size, dtype=np.uint8)
            for key, at in zip(reversed(order), reversed(through), strict=True):
                p = places[key]
                slots[at] = prints[key] ^ slots[p[:, 0]] ^ slots[p[:, 1]] ^ slots[p[:, 2]] ^ slots[at]
            return seed, segment, segments, slots
    raise ValueError("no seed gives a filter: are the keys distinct?")


def fuse_probe(keys: np.ndarray, seed: int, segment: int, segments: int, slots: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for one other in 256."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    places, prints = fuse_places(keys, seed, segment, segments)
    return (slots[places[:, 0]] ^ slots[places[:, 1]] ^ slots[places[:, 2]]) == prints


def build_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, slots = fuse_build(pdf["key"].drop_duplicates().to_numpy().astype(np.uint64))
    return pd.DataFrame({"snapshot": pdf["snapshot"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "seed": seed, "segment": segment, "segments": segments, "slots": [slots.tobytes()]})


def screen(later: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A row for each digest and earlier snapshot whose filter lets it through."""
    keys, found = later["key"].to_numpy().astype(np.uint64), []
    for f in filters.itertuples():  # one for each snapshot
        after = np.flatnonzero(later["snapshot"].to_numpy() > f.snapshot)
        hit = after[fuse_probe(keys[after], int(f.seed), int(f.segment), int(f.segments), np.frombuffer(f.slots, dtype=np.uint8))]
        found.append(later.iloc[hit].assign(hit=f.snapshot))
    return pd.concat(found)[["snapshot", "digest", "keep", "n", "hit"]] if found else later.iloc[:0].assign(hit=0)[["snapshot", "digest", "keep", "n", "hit"]]


def entries(rows: DataFrame, buckets: int) -> DataFrame:
    """The exact tables: a row for each snapshot and distinct digest. rows: id, digest, snapshot."""
    key = F.xxhash64("digest")
    return rows.groupBy("snapshot", "digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).withColumns({"key": key, "bucket": F.pmod(key, F.lit(buckets)).cast("int")})


def snapshot_filters(tables: DataFrame) -> DataFrame:
    """One static filter for each bucket of each snapshot."""
    return tables.select("snapshot", "bucket", "key").groupBy("bucket", "snapshot").applyInPandas(build_filter, FILTER_SCHEMA)


def groups_of(tables: DataFrame) -> DataFrame:
    """digest, keep and n of each group of two rows or more, within a snapshot or over several."""
    kind = dict(tables.dtypes)["keep"]
    as_text = tables.withColumn("keep", F.col("keep").cast("string"))  # next to a null, pandas would make long ids doubles
    newest = tables.agg(F.max("snapshot")).first()[0]
    filters = cut(snapshot_filters(tables.filter(F.col("snapshot") < F.lit(newest))))
    probing = as_text.select("bucket", "snapshot", "digest", "keep", "n", "key").filter(F.col("snapshot") > F.lit(tables.agg(F.min("snapshot")).first()[0]))
    passed = cut(probing.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, SCREENED.format(id="string")).withColumn("keep", F.col("keep").cast(kind)))
    exact = tables.select(F.col("snapshot").alias("hit"), "digest", F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    met = cut(passed.join(exact, ["hit", "digest"]))
    sides = met.select("digest", "snapshot", "keep", "n").unionByName(met.select("digest", F.col("hit").alias("snapshot"), F.col("old_keep").alias("keep"), F.col("old_n").alias("n")))
    over = sides.dropDuplicates(["digest", "snapshot"]).groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    return over.unionByName(tables.filter("n > 1").select("digest", "keep", "n")).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def deduplicate(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Groups of equal texts over snapshots and a batch; the largest id of a group stays.

    ``snapshot`` is the number of the immutable snapshot that a row is in, in the order in which they came; the rows
    with the largest number, and with null, are the new batch. Returns for each row: id_col, keep_id, group_size, kept,
    text_sha256. Null texts count as empty. A null id never stays unless its whole group has null ids; rows that repeat
    the largest id all stay. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.coalesce(snapshot.cast("int"), F.lit(2**31 - 1)).alias("snapshot")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    light = cut(rows.select("id", "digest", "snapshot"))
    buckets = max(partitions(spark), -(-light.count() // bucket_keys))
    groups = cut(groups_of(cut(entries(light, buckets))))
    small = groups.count() <= SEND_ROWS
    sent = F.broadcast(groups) if small else groups

    # Only rows of groups are sent on with their text; a hot group is salted in proportion to its size.
    texts = rows.select("id", "digest", "text").join(sent, "digest")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    met = texts.select("id", "digest", "n", "keep", "text", F.when(F.col("n") > SALT_ROWS, F.pmod(F.xxhash64("id"), salts)).otherwise(0).cast("int").alias("salt"))
    stays = texts.filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest").agg(F.max("text").alias("keep_text"), F.max("n").alias("n"))
    stays = stays.select("digest", "keep_text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    same = F.col("text") == F.col("keep_text")
    keep = F.when(same, F.col("keep")).otherwise(F.col("id"))
    checked = met.join(stays, ["digest", "salt"]).select("id", keep.alias("keep_id"), F.when(same, F.col("n")).otherwise(F.lit(1)).alias("group_size"), "digest")
    single = light.join(sent, "digest", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return checked.unionByName(single).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def digests(rows: DataFrame) -> DataFrame:
    """A row for each different text of (id, text): digest, key, id (the largest), n and text."""
    each = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    return each.groupBy("digest").agg(F.max("id").alias("id"), F.count("*").alias("n"), F.first("text").alias("text")).withColumn("key", F.xxhash64("digest"))


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> None:
    """Write an immutable snapshot of docs once: its exact table under ``path``/exact, sorted by bucket, and a filter for each bucket under ``path``/filters.

    The number of buckets follows from this snapshot's texts and is stored with its filters. Null texts count as empty.
    """
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    exact = digests(rows)
    buckets = max(1, -(-rows.select(F.xxhash64("text")).distinct().count() // bucket_keys))
    exact = exact.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    exact.repartition("bucket").sortWithinPartitions("bucket", "digest").write.parquet(f"{path}/exact")
    keys = docs.sparkSession.read.parquet(f"{path}/exact").select(F.lit(0).alias("snapshot"), "bucket", "key")
    keys.groupBy("bucket", "snapshot").applyInPandas(build_filter, FILTER_SCHEMA).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def screen_batch(batch: DataFrame, snapshots: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, group_size, known_in, known_id, kept, text_sha256 of each row of a batch, against snapshots written before.

    The batch's own copies are grouped first. A text that a snapshot's filters let through is compared, byte by byte, with
    its exact table; known_in is the number of the last snapshot that has it, known_id its id there, and both are null for
    a new text. Of a new text the row with the largest id stays; rows that repeat it all do. A snapshot without a text
    that passes its filters is not read beyond these.
    """
    spark = batch.sparkSession
    rows = batch.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    own = cut(digests(rows))
    kind, met = dict(own.dtypes)["id"], None
    for number, path in enumerate(snapshots):
        filters = spark.read.parquet(f"{path}/filters")
        first = filters.select("buckets").first()
        if first is None:  # a snapshot of no texts
            continue
        asked = own.select("digest", "key", F.lit(1).alias("snapshot"), F.lit("").alias("keep"), "n", F.pmod("key", F.lit(first[0])).cast("int").alias("bucket"))
        passed = asked.groupBy("bucket").cogroup(filters.drop("buckets").groupBy("bucket")).applyInPandas(screen, SCREENED.format(id="string"))
        passed = cut(passed.select("digest"))
        if passed.isEmpty():
            continue
        exact = spark.read.parquet(f"{path}/exact").select("digest", F.col("id").cast(kind).alias("known_id"), F.col("text").alias("known"))
        same = exact.join(passed, "digest").join(own.select("digest", "text"), "digest").filter(F.col("known") == F.col("text"))
        same = same.select("digest", F.struct(F.lit(number).alias("known_in"), "known_id").alias("at"))
        met = same if met is None else met.unionByName(same)
    at = own.select("digest", F.lit(None).cast(f"struct<known_in:int,known_id:{kind}>").alias("at")) if met is None else own.select("digest").join(met.groupBy("digest").agg(F.max("at").alias("at")), "digest", "left")
    groups = own.select("digest", F.col("id").alias("largest"), "n").join(at, "digest")
    out = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).join(groups, "digest")
    kept = F.isnull("at") & F.col("id").eqNullSafe(F.col("largest"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("group_size"), "at.known_in", "at.known_id", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the id deals documents to two snapshots and the new batch."""
    return deduplicate(read(spark, sf_dir, "documents"), snapshot=F.pmod(F.xxhash64("doc_id"), F.lit(3)))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
