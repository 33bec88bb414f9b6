"""Benchmark decontamination by winnowing.

Of the hashes of all word 5-grams, the smallest in each window of nine is kept, so that every run of 13 words keeps at
least one, and equal runs keep the same. Fingerprints of documents and items are joined, and each hit is extended word
by word to both sides; runs of 13 equal words or more count. Items of fewer words are single windows, looked up at
every position for those lengths that the benchmark has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import named, read

WINDOW = 13
GRAM = 5
#: Bits of the screen that documents' fingerprints pass before they leave their task; its size never grows.
SCREEN_BITS = 1 << 22

#: A-Z to a-z; ASCII other than letters and digits to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

FINGERPRINTS = "array<struct<hash:bigint,len:int,pos:int,around:array<bigint>>>"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; n is mixed in."""
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(total)]
    total ^= total >> np.uint64(29)
    total *= np.uint64((0xBF58476D1CE4E5B9 + 2 * n) & (2**64 - 1))
    return total ^ (total >> np.uint64(32))


def winnow(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the kept grams: of each window of words, the rightmost smallest."""
    grams, w = gram_hashes(words, gram), window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    at = np.unique(np.arange(len(view)) + w - 1 - view[:, ::-1].argmin(axis=1))
    return grams[at], at


def fingerprint(text: str | None, lengths: tuple[int, ...], screen: np.ndarray | None, pad: int, item: bool) -> tuple[int, list[dict]]:
    """(words, fingerprints). An item gives those of its windows; a document those that pass the screen."""
    words = word_hashes(text)
    passed = lambda h: np.ones(len(h), dtype=bool) if screen is None else (screen[(h & np.uint64(SCREEN_BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1
    found: list[dict] = []
    if len(words) >= WINDOW:
        hashes, at = winnow(words, WINDOW, GRAM)
        if (ok := passed(hashes)).any():
            margin = WINDOW - GRAM
            wide = np.concatenate([np.full(margin, pad, np.uint64), words, np.full(margin, pad, np.uint64)]).view(np.int64)
            found += [{"hash": h, "len": WINDOW, "pos": p, "around": wide[p : p + 2 * margin + GRAM]} for h, p in zip(hashes[ok].view(np.int64).tolist(), at[ok].tolist(), strict=True)]
    for n in (len(words),) if item else lengths:
        if 0 < n < WINDOW and n <= len(words):
            hashes = gram_hashes(words, n)
            found += [{"hash": h, "len": n, "pos": p, "around": None} for p in np.flatnonzero(passed(hashes)).tolist() for h in hashes[p : p + 1].view(np.int64).tolist()]
    return len(words), found


def fingerprints(rows: DataFrame, lengths: tuple[int, ...] = (), screen=None, pad: int = 0, item: bool = False) -> DataFrame:
    """id, n_words and fingerprints of each row of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if screen is None else screen.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = [fingerprint(t, lengths, bits, pad, item) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].array, "tid": part["tid"].array, "n_words": [n for n, _ in out], "found": [f for _, f in out]})

    kind = dict(rows.dtypes)["id"]  # ids pass pandas as text: next to a null, it would make long ones doubles
    out = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(run, f"id string, tid long, n_words long, found {FINGERPRINTS}")
    return out.withColumn("id", F.col("id").cast(kind))


def screen_of(items: DataFrame):
    """The bits of all items' fingerprints, as a broadcast variable: SCREEN_BITS at most, whatever the benchmark's size."""
    bit = F.col("hash").bitwiseAND(SCREEN_BITS - 1)
    words = items.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & {63} as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    screen = np.zeros(SCREEN_BITS // 64, dtype=np.uint64)
    for word, bits in words:
        screen[word] = np.uint64(bits & (2**64 - 1))
    return items.sparkSession.sparkContext.broadcast(screen)


def equal_run() -> tuple[Column, Column]:
    """Equal words left and right of a hit's gram."""
    margin = WINDOW - GRAM
    same = F.array_join(F.zip_with("around", "item_around", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    left = F.length(F.regexp_extract(F.substring(same, 1, margin), "1*$", 0))
    right = F.length(F.regexp_extract(F.substring(same, margin + GRAM + 1, margin), "^1*", 0))
    return F.when(F.col("len") < WINDOW, 0).otherwise(left), F.when(F.col("len") < WINDOW, 0).otherwise(right)


def covered(spans: Column) -> Column:
    """Places that sorted spans (lo, hi) cover, from one span to the next."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], s["next"]) + 1)).alias("n"), F.greatest(s["next"], x["hi"] + 1).alias("next"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("next")), step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", text_key: str | None = None) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words, and is hit by nothing. Rows that repeat both id and text give a row each. Items without words are ignored, items that repeat an id are one item. Items with a null id hit like
    others, but are not among the items that are counted and listed. With text_key, a column of that name has the hash
    of each text.
    """
    text, item_text = named(text_col), named(item_text_col)
    marks = fingerprints(items.select(named(item_col).alias("id"), item_text.alias("text"), F.xxhash64(item_text).alias("tid")), pad=1, item=True)
    marks = marks.select(F.struct("id").alias("item"), F.inline("found")).select("item", "hash", "len", F.col("around").alias("item_around"))
    lengths = tuple(sorted(r[0] for r in marks.filter(F.col("len") < WINDOW).select("len").distinct().collect()))
    found = fingerprints(docs.select(named(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tid")), lengths, screen_of(marks))
    # Each row also goes on under a key of its own, with a length that no item has; there are as many of those as rows.
    none = F.lit(None).cast(FINGERPRINTS.removeprefix("array<").removesuffix(">"))
    rows = found.select("id", "tid", "n_words", F.explode(F.array_append("found", none)).alias("f")).select("id", "tid", "n_words", F.coalesce("f.hash", F.xxhash64("id", "tid")).alias("hash"), F.coalesce("f.len", F.lit(0)).alias("len"), "f.pos", "f.around")
    left, right = equal_run()
    hits = rows.join(marks, ["hash", "len"], "left").withColumns({"left": left, "right": right})
    size = F.when(F.col("len") < WINDOW, F.col("len")).otherwise(F.lit(GRAM))
    real = F.col("item").isNotNull() & ((F.col("len") < WINDOW) | (F.col("left") + F.col("right") + GRAM >= WINDOW))
    span = F.when(real, F.struct((F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + size + F.col("right") - 1).alias("hi")))
    by_doc = hits.select("id", "tid", "n_words", "len", span.alias("span"), F.when(real, F.col("item.id").cast("string")).alias("item")).groupBy("id", "tid").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("len") == 0).alias("rows"), F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
    by_doc = by_doc.withColumn("n_hit", covered(F.array_sort("spans"))).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return by_doc.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *([F.col("tid").alias(text_key)] if text_key else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
