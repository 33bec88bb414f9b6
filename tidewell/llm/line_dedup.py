"""Line deduplication by deletion neighbourhoods.

Two lines are within one edit of each other iff they are equal, or equal once a character is deleted at the same
position of both (a substitution), or once one is deleted from the longer (an insertion). So every line emits all its
variants with one character deleted as hashed keys, equal variants are joined, the edit distance is verified, and the
earliest line stays.

As an edit lies in one half of a line, lines within one edit share the other half: only lines that meet another in such
a half emit variants, and only for the half that may differ. No pair within one edit is lost by that. Which halves are
shared is counted first; a bitmap of those then screens the lines in a second scan, so that few leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, named, read, screen_of

#: Shorter lines are compared for equality only: one edit of a short line is often another word.
MIN_CHARS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = "place struct<no_id:boolean,id:{id},line:int,tid:bigint>"
#: Bits of the screen that lines pass before they leave their task, less one; its size never grows.
SCREEN_MASK = (1 << 24) - 1
NOT_BLANK = r"[^ \t\n\x0B\f\r]"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def neighbourhood(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without its i-th character, in linear time."""
    c = mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + BASE)
    n = len(c)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:n])])  # sum of c[i] * BASE ** i
    # Behind the deleted character, exponents are one too high: the prefix is raised by one instead.
    return int(mix(sums[n:] * BASE + np.uint64(n))[0]), mix(sums[:n] * BASE + (sums[n] - sums[1:]) + np.uint64(n - 1))


def half_keys(line: str) -> list[tuple[int, int, int]]:
    """(m, side, hash) keys under which lines within one edit meet: m is the longer line's length, one half stays equal."""
    n, keys = len(line), []
    for m in (n, n + 1):
        h = m // 2
        for side, part in ((1, line[:h]), (0, line[n - (m - h) :])):  # 1: the first half is equal, the edit is at h or later
            keys.append((m, side, xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), 2 * m + side) - (1 << 63)))
    return keys


def all_keys(min_chars: int):
    """key and line hash of each line's halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                keys, hashes = [], []
                for text in batch["text"].iloc[at : at + 512]:
                    for line in text.split("\n"):
                        if len(line) >= min_chars:
                            keys += [k for _, _, k in half_keys(line)]
                            hashes += [xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)] * 4
                yield pd.DataFrame({"key": keys, "line": hashes}, dtype="int64")

    return run


def screened_lines(min_chars: int, screen):
    """Lines with a key that passes the screen: digest, place, text and keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = screen.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                out = []
                for r in batch.iloc[at : at + 512].itertuples():
                    for i, line in enumerate(r.text.split("\n")):
                        if len(line) >= min_chars:
                            keys = [k for k in half_keys(line) if bits[(k[2] & SCREEN_MASK) >> 3] >> (k[2] & 7) & 1]
                            if keys:
                                place = {"no_id": pd.isna(r.id), "id": None if pd.isna(r.id) else r.id, "line": i, "tid": r.tid}
                                out.append((hashlib.sha256(line.encode("utf-8", "surrogatepass")).digest(), place, line, [{"m": m, "side": side, "key": k} for m, side, k in keys]))
                yield pd.DataFrame(out, columns=["digest", "place", "line", "keys"])

    return run


def variants():
    """A pandas UDF of a line and its met (m, side): its own hash at position -1 where a longer line may match, and its
    variants with the character at a position deleted, in the halves that may differ."""

    @F.pandas_udf("v array<long>, pos array<int>")
    def run(lines: pd.Series, met: pd.Series) -> pd.DataFrame:
        out = []
        for line, keys in zip(lines, met, strict=True):
            own, without = neighbourhood(line)
            n, at = len(without), set()
            for key in keys:
                if key["m"] == n:
                    at.update(range(n // 2, n) if key["side"] else range(n // 2))
                else:
                    at.add(-1)
            at = np.array(sorted(at), dtype=np.int32)
            v = np.where(at < 0, np.uint64(own), without[np.maximum(at, 0)])
            out.append((v.view(np.int64), at))
        return pd.DataFrame(out, columns=["v", "pos"])

    return run


def places(rows: DataFrame) -> DataFrame:
    """A row for each line that is not blank: its place (id, line number) and digest."""
    lines = rows.select("id", "tid", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike(NOT_BLANK))
    place = F.struct(F.isnull("id").alias("no_id"), "id", "line", "tid")
    return lines.select(place.alias("place"), F.unhex(F.sha2("text", 256)).alias("digest"))


def near_earlier(rows: DataFrame, min_chars: int) -> DataFrame:
    """Digests of lines that have an earlier line one edit away."""
    keys = rows.select("text").mapInPandas(all_keys(min_chars), "key long, line long")
    met = cut(keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a < b").select("key"))
    kind = dict(rows.dtypes)["id"]  # ids pass pandas as text: next to a null, it would make long ones doubles
    texts = rows.withColumn("id", F.col("id").cast("string"))
    seen = texts.mapInPandas(screened_lines(min_chars, screen_of(met, SCREEN_MASK)), f"digest binary, {PLACE.format(id='string')}, line string, keys array<struct<m:int,side:int,key:long>>")
    seen = seen.withColumn("place", F.col("place").cast(PLACE.format(id=kind).removeprefix("place ")))
    distinct = seen.groupBy("digest").agg(F.min("place").alias("place"), F.first("line").alias("line"), F.first("keys").alias("keys"))
    exploded = distinct.select("digest", "place", "line", F.inline("keys")).join(met, "key")
    lines = cut(exploded.groupBy("digest").agg(F.first("place").alias("place"), F.first("line").alias("line"), F.collect_set(F.struct("m", "side")).alias("met")))
    near = lines.select("digest", "place", variants()("line", "met").alias("n")).select("digest", "place", F.inline(F.arrays_zip(F.col("n.v").alias("v"), F.col("n.pos").alias("pos"))))

    # Lines under one key differ in one character at most: their number is bounded by the alphabet and the length, not by
    # the corpus. All three windows share one exchange by v.
    me, by_v = F.struct("place", "digest"), Window.partitionBy("v")
    found = near.select("digest", "place", "pos", F.min(F.when(F.col("pos") < 0, me)).over(by_v).alias("shorter"), F.min(F.when(F.col("pos") >= 0, me)).over(by_v).alias("longer"), F.min(me).over(Window.partitionBy("v", "pos")).alias("equal"))
    others = F.when(F.col("pos") < 0, F.array("longer")).otherwise(F.array("shorter", "equal"))
    earlier = found.select("digest", "place", F.explode(F.filter(others, lambda o: o["place"] < F.col("place"))).alias("other")).select("digest", F.col("other.digest").alias("other")).distinct()
    text = lines.select("digest", "line")
    verified = earlier.join(text, "digest").join(text.select(F.col("digest").alias("other"), F.col("line").alias("other_line")), "other")
    return verified.filter(F.levenshtein("line", "other_line", 1) >= 0).select("digest").distinct()


def deduplicate_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its repeated lines, and n_lines and n_dropped, which replace columns of these names.

    A line goes if an earlier one (by id, then line number; null ids last; texts that share an id in the order of a
    hash) is equal or, with max_edits 1 and min_chars characters or more, at most one edit away, whether or not that one
    itself stays. Blank lines (ASCII white space only) stay. A null text counts as one empty line. Rows that repeat both
    id and text are one text at one place, and stay or lose the same lines.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    lines = places(rows)
    first = lines.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    if max_edits:
        near = near_earlier(rows, min_chars).withColumn("near", F.lit(True))
        first = first.join(near, "digest", "left")
    else:
        first = first.withColumn("near", F.lit(False))
    some = cut(first.filter("n > 1 OR near"))  # of its own, so that Spark can split the join at a line that very many texts have
    gone = lines.join(some, "digest").filter(F.coalesce("near", F.lit(False)) | (F.col("place") != F.col("first")))
    gone = gone.select("place.id", "place.tid", "place.line").groupBy("id", "tid").agg(F.collect_set("line").alias("gone")).withColumnsRenamed({"id": "gone_id", "tid": "gone_tid"})
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    held = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), named(id_col).alias("id"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("tid"))
    joined = held.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tid") == F.col("gone_tid")), "left")
    lines = F.split(text, "\n")
    # The outer transform binds the lines once for all of their numbers.
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))[0]
    counts = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    value = lambda c: F.when(F.size("gone") > 0, kept).otherwise(F.col("row").getField(c)) if c == text_col else F.col("row").getField(c)
    return joined.select(*(value(c).alias(c) for c in docs.columns if c not in counts), *(c.alias(name) for name, c in counts.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
f AS (SELECT t, length(t) AS n, min((doc_id, i)) AS p FROM l WHERE regexp_matches(t, '[^ \t\n\v\f\r]') GROUP BY t),
k AS (SELECT t, n, p, m, left(t, m // 2) AS a, right(t, m - m // 2) AS b FROM (SELECT *, unnest([n, n + 1]) AS m FROM f WHERE n >= {MIN_CHARS})),
c AS (
  SELECT x.t, y.t AS o, x.p, y.p AS q, x.n, y.n AS o_n FROM k x JOIN k y ON x.m = y.m AND x.a = y.a WHERE x.t <> y.t
  UNION SELECT x.t, y.t, x.p, y.p, x.n, y.n FROM k x JOIN k y ON x.m = y.m AND x.b = y.b WHERE x.t <> y.t),
near AS (
  SELECT DISTINCT t FROM c WHERE q < p AND abs(n - o_n) <= 1
  AND len(list_filter(range(0, greatest(n, o_n)), lambda j: left(t, j) = left(o, j) AND substr(t, j + 1 + CASE WHEN n >= o_n THEN 1 ELSE 0 END) = substr(o, j + 1 + CASE WHEN o_n >= n THEN 1 ELSE 0 END))) > 0),
d AS (SELECT l.doc_id, l.i, l.t, f.t IS NOT NULL AND (near.t IS NOT NULL OR f.p <> (l.doc_id, l.i)) AS gone FROM l LEFT JOIN f USING (t) LEFT JOIN near USING (t))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
