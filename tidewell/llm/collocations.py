"""Phrase collocations by truncated suffixes.

Every word starts a suffix of its piece of text, cut to max_n words. A task turns the words of a batch of texts into
numbers in their order, counts its equal suffixes, and sends the different ones, sorted, to ranges of (language, first
word, ...). The ranges are cut by suffixes of a few documents, as Spark's own range partitioning cuts them, so that a
frequent first word, or pair, takes as many ranges as it needs: what the documents say about the cuts decides which task
counts a suffix, never whether it counts.

A range sorts its suffixes in reverse order, where all suffixes that begin with a phrase stand together, and counts
every prefix in one go: the stack of open prefixes, a level at a time. Prefixes of the first and of the last suffix may
go on in the ranges beside; those go out whatever they count, all others only from min_count on, and one sum over the
ranges follows. The empty prefix counts all words. Parts of candidates are as frequent as they are, so joins with the
same table give them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import named, partitions, read, stored

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, what separates pieces as line feeds, tabs as blanks.
FOLDED = bytes(10 if b in SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that a task counts at a time; a longer text is taken in parts.
BATCH_BYTES = 6_000_000
#: Bytes of text whose suffixes a range is planned to take.
RANGE_BYTES = 8_000_000
#: Suffixes of the documents that are looked at for each cut, and most in all.
LOOKS, MOST_LOOKS = 20, 1_000_000

#: Groups of a language's phrases whose best ones are found apart.
GROUPS = 16

SENT = "shard long, lang string, words binary, ids binary, counts binary"
FOUND = "lang string, phrase binary, size int, n long"


def parts(text: bytes, max_n: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts, and the bytes of each in which its suffixes begin; a part reads on for max_n - 1 words."""
    at = 0
    while len(text) - at > BATCH_BYTES:
        end = re.compile(rb"[ \n]|$").search(text, at + BATCH_BYTES).start()
        more = re.compile(rb"(?: *[^ \n]+){0,%d}" % (max_n - 1)).match(text, end).end()
        yield text[at:more], end - at
        at = end
    yield text[at:], len(text) - at


def batches_of(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[tuple[str, bytes, int]]:
    """(language, folded text, bytes in which suffixes begin): texts of a language together, long ones in parts."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part, begins in parts(text.as_py().translate(FOLDED), max_n):
                if len(part) >= BATCH_BYTES:
                    yield lang, part, begins
                    continue
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= BATCH_BYTES:
                    for known, texts in held.items():
                        joined = b"\n".join(texts)
                        yield known, joined, len(joined)
                    held, size = {}, 0
    for known, texts in held.items():
        joined = b"\n".join(texts)
        yield known, joined, len(joined)


def suffixes(text: bytes, begins: int, max_n: int, more: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in order, the suffixes as rows of their numbers from 1 (0 behind the end), and the numbers of the words ``more``."""
    u = np.frombuffer(text, dtype=np.uint8)
    gap = (u == 32) | (u == 10)
    edges = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    piece = np.searchsorted(np.flatnonzero(u == 10), starts).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(u[~gap])])
    begun = starts < begins
    del gap, edges, ends, offsets
    coded = pa.concat_arrays([words, pa.array(more, pa.binary())]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    ids = number[coded.indices.to_numpy()]
    ids, others = ids[: len(starts)], ids[len(starts) :]
    rows = np.zeros((len(ids), max_n), dtype=np.int32)
    for d in range(max_n):
        n = max(0, len(ids) - d)
        rows[:n, d] = np.where(piece[d:] == piece[:n], ids[d:], 0)
    return coded.dictionary.take(pa.array(order)), rows[begun], others


def packed(rows: np.ndarray) -> np.ndarray:
    """One integer for each row of numbers, in the order of rows."""
    base = int(rows.max(initial=0)) + 1
    key = rows[:, 0].astype(np.int64)
    for d in range(1, rows.shape[1]):
        if (int(key.max(initial=0)) + 1) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + rows[:, d]
    return key


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where in it each different one begins."""
    order = np.argsort(key)
    sorted_key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else order


def sending(max_n: int, cuts: dict[str, tuple[int, list[tuple[bytes, ...]]]]):
    """Texts to the different suffixes of a batch: one row for each range that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, begins in batches_of(batches, max_n):
            first, own = cuts.get(lang, (-1 - zlib.crc32(lang.encode()), []))
            words, rows, of_cuts = suffixes(text, begins, max_n, [w for cut in own for w in cut])
            bounds = np.zeros((len(own), max_n), dtype=np.int32)
            filled = [(i, d) for i, cut in enumerate(own) for d in range(len(cut))]
            if filled:
                bounds[tuple(np.array(filled).T)] = of_cuts
            key = packed(np.concatenate([rows, bounds]))  # rows and cuts in one order
            key, of_cuts = key[: len(rows)], key[len(rows) :]
            order, at = runs(key)
            counts, rows, key = np.diff(np.append(at, len(order))), rows[order[at]], key[order[at]]
            ends = [0, *np.searchsorted(key, of_cuts).tolist(), len(rows)]
            out = []
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    used = np.unique(rows[a:b])
                    used = used[used > 0]
                    local = np.where(rows[a:b] > 0, np.searchsorted(used, rows[a:b]) + 1, 0).astype("<i4")
                    out.append((first + i, lang, b" ".join(words.take(pa.array(used - 1)).to_pylist()), local.T.tobytes(), counts[a:b].astype("<i4").tobytes()))
            if out:
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "lang", "words", "ids", "counts"])

    return run


def looking(max_n: int, step: int):
    """Every ``step``-th suffix, as words with blanks between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, begins in batches_of(batches, max_n):
            words, rows, _ = suffixes(text, begins, max_n, [])
            words = words.to_pylist()
            seen = [b" ".join(words[i - 1] for i in row if i) for row in rows[min(step, len(rows)) // 2 :: step].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.binary())], names=["lang", "suffix"])

    return run


def range_cuts(texts: DataFrame, max_n: int, range_bytes: int) -> dict[str, tuple[int, list[tuple[bytes, ...]]]]:
    """For each language the number of its first range, and the suffixes at which the next ones begin."""
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(partitions(texts.sparkSession), -(-size // range_bytes))
    looks = min(LOOKS * ranges, MOST_LOOKS)
    share = min(1.0, 2.0 * looks / max(n, 1))
    some = texts.sample(share, seed=7) if share < 1 else texts
    seen = some.mapInArrow(looking(max_n, max(1, int(size * share / 6 / looks))), "lang string, suffix binary").collect()
    seen = sorted((r.lang, tuple(bytes(r.suffix).split(b" "))) for r in seen if r.suffix)
    chosen = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    cuts, number = {}, 0
    for lang in sorted({lang for lang, _ in seen}):
        own = [suffix for other, suffix in chosen if other == lang]
        cuts[lang] = (number, own)
        number += len(own) + 1
    return cuts


def counting(max_n: int, min_count: int):
    """A range's suffixes to the counts of their prefixes."""

    def run(table: pa.Table) -> pa.Table:
        lists = [w.split(b" ") for w in table["words"].to_pylist()]
        coded = pa.array([w for part in lists for w in part], pa.binary()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        words = coded.dictionary.take(pa.array(order))
        ids, at, found = number[coded.indices.to_numpy()], 0, []
        for part, local in zip(lists, table["ids"].to_pylist(), strict=True):
            own = np.concatenate([[0], ids[at : at + len(part)]]).astype(np.int32)
            found.append(own[np.frombuffer(local, dtype="<i4").reshape(max_n, -1).T])
            at += len(part)
        rows, n = np.concatenate(found), np.concatenate([np.frombuffer(c, dtype="<i4") for c in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(packed(rows))[::-1]
        rows, n = rows[order], n[order]
        phrase, size, total = [b""], [0], [int(n.sum())]
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for d in range(max_n):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            first = np.flatnonzero(new)
            sums = np.add.reduceat(n, first)
            keep = sums >= min_count
            keep[[0, -1]] = True
            keep &= rows[first, d] > 0
            prefixes = rows[first[keep], : d + 1] - 1
            columns = [words.take(pa.array(prefixes[:, i])).to_pylist() for i in range(d + 1)]
            phrase += [b" ".join(p) for p in zip(*columns, strict=True)]
            size += [d + 1] * int(keep.sum())
            total += sums[keep].tolist()
        lang = table["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": pa.array(phrase, pa.binary()), "size": pa.array(size, pa.int32()), "n": pa.array(total, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, max_n: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, phrase, size, n: phrases of 1 to max_n words that are there min_count times or more; size 0 counts all words."""
    texts = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), named(text_col).cast("binary").alias("text")).filter("length(text) > 0")
    sent = texts.mapInArrow(sending(max_n, range_cuts(texts, max_n, range_bytes)), SENT)
    found = sent.groupBy("shard", "lang").applyInArrow(counting(max_n, min_count), FOUND)
    sums = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= min_count))
    return sums.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "n")


def span(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, absorbed: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to max_n words.

    Words are what blanks and tabs separate in pieces that . , ; : ! ? and line ends separate, with A-Z in lower case. a
    is a phrase's count, from min_count on; l and r are those of its two parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)), at equal scores the one after fewer words. Products are decimals: exact for counts
    below 10^15. A phrase goes if a longer candidate that holds it has ``absorbed`` percent of its count or more. Equal
    scores rank by a, then by the phrase's bytes. A null language is ``und``; null and empty texts have no words; rows
    that repeat count as often as they are there; a language without candidates has no rows. Other columns are ignored.
    """
    counts = stored(phrase_counts(docs, max_n, min_count, text_col, lang_col, range_bytes))
    words = F.split("phrase", " ", -1)
    candidates = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))

    ks = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", ks).select("lang", "phrase", "a", "k", span(F.col("words"), F.lit(1), F.col("k")).alias("left"), span(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    d = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * d("a") * d("a"), "bottom": d("l") * d("r")}).withColumn("score", F.expr("top div bottom"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: span(F.col("words"), i, m)))))
    longer = candidates.filter("size > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    # First the best of each group of phrases: a language's last window then sees GROUPS * most rows, whatever its size.
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    best_by = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))).filter(F.col("rank") <= most)
    best = best_by(best_by(left.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))), "group"))
    all_words = counts.filter("size = 0").select("lang", "n")
    return best.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM o, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * u.a * u.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:cut], ' ') JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
SELECT b.lang, row_number() OVER z AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n ON n.lang = b.lang LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * b.a WINDOW z AS (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) QUALIFY row_number() OVER z <= 2000
"""
