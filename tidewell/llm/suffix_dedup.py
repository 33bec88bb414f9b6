"""Removal of byte strings that occur more than once in a corpus, by sorting suffixes.

A suffix sort needs all suffixes with a common prefix in one shard. Windows of 200 bytes are therefore dealt by their
anchor, the smallest hash of a 32-byte string in the window: equal windows have equal anchors at equal offsets. The
windows of one anchor occurrence follow each other and form a segment of at most 368 bytes.

1. Anchors that occur once cannot lie in a repeated window. They are counted, and a bitmap keeps most of them from
   leaving their task in the scan that finds the others' places.
2. Equal segments become one with a count, before anything is sorted: a passage in a third of all documents is one row.
3. Segments of anchors with several different ones are sorted in shards (suffix_sort), each start keeping the length
   of the prefix that it shares with its neighbours. A shard streams to disk and may be far larger than the sort's
   memory. Texts are sent on once, for cutting the segments and for taking out what is repeated.
4. An anchor whose different segments alone would exceed a shard, so a task, is dealt by whole windows instead; equal
   windows meet in one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import suffix_sort
from tidewell.llm.common import named, partitions, read, screen_of, stored

LENGTH = suffix_sort.CAP
GRAM = 32  # a power of two
SPAN = LENGTH - GRAM + 1
#: Windows that are hashed at once.
PIECE = 1 << 16
#: Bytes of texts that are searched for anchors at once.
BATCH_BYTES = 1 << 20
#: Bytes that a shard is planned to have, and what of it the sort holds in memory.
SHARD_BYTES, MEMORY = 64 << 20, 8 << 20
#: Bits of the screen of repeated anchors, less one; its size never grows.
SCREEN_MASK = (1 << 24) - 1
LOW = np.uint64((1 << 24) - 1)


def anchors(texts: Sequence[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, anchor, its position, first and last start of the windows that it is the anchor of), in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data, end = b"".join(texts), np.cumsum(sizes)
    near_end = np.zeros(len(data) + LENGTH, bool)  # starts with less than LENGTH bytes of their text behind them
    for e, n in zip(end.tolist(), sizes.tolist(), strict=True):
        near_end[max(e - n, e - LENGTH + 1) : e] = True
    found, last = [], -1
    for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - begin), begin)
        h = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        size, factor = 1, 0xD6E8FEB86659FD93
        while size < GRAM:
            h = h[:-size] * np.uint64(factor) + h[size:]
            size, factor = 2 * size, factor * factor % 2**64
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        least = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64))  # of equal ones the last
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(h) - SPAN + 1], least[SPAN - size :])
        start = np.flatnonzero(~near_end[begin : begin + len(least)])
        if not len(start):
            continue
        at = (LOW - (least[start] & LOW)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[at[0] + begin != last], at[1:] != at[:-1]]))
        if found and (not len(new) or new[0]):  # goes on from the piece before
            found[-1][3][-1] = start[(new[0] if len(new) else len(start)) - 1] + begin
        if len(new):
            found.append((h[at[new]], at[new] + begin, start[new] + begin, start[np.append(new[1:], len(start)) - 1] + begin))
        last = at[-1] + begin
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    anchor, position, first, final = (np.concatenate(x) for x in zip(*found, strict=True))
    number = np.searchsorted(end, first, side="right")
    shift = (end - sizes)[number]
    return number, anchor, position - shift, first - shift, final - shift


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def parts_of(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """A batch in parts of about BATCH_BYTES, with the texts' bytes."""
    begin, texts, size = 0, [], 0
    for i, text in enumerate(batch["text"]):
        texts.append(encode(text))
        size += len(texts[-1])
        if size >= BATCH_BYTES:
            yield batch.iloc[begin : i + 1], texts
            begin, texts, size = i + 1, [], 0
    if texts:
        yield batch.iloc[begin:], texts


def all_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, texts in parts_of(batch):
            yield pd.DataFrame({"key": anchors(texts)[1].view(np.int64)})


def places(screen):
    """Anchors that pass the screen: with the hash of the segment, id, tid, and the position and offsets of the first and last start before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = screen.value
        for batch in batches:
            for rows, texts in parts_of(batch):
                number, anchor, p, first, last = anchors(texts)
                low = (anchor & np.uint64(SCREEN_MASK)).astype(np.int64)
                ok = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                number, anchor, p, first, last = (x[ok] for x in (number, anchor, p, first, last))
                seg = np.fromiter((xxhash.xxh3_64_intdigest(texts[i][x : y + LENGTH]) for i, x, y in zip(number.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(ok))
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "seg": seg.view(np.int64), "id": rows["id"].array[number], "tid": rows["tid"].array[number], "at": (p << 16) | ((p - first) << 8) | (p - last)})

    return run


def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "tid": batch["tid"], "packed": [pack.compress(encode(t)) for t in batch["text"]]})


def cut_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        batch = batch[batch["anchor"].notna()]
        for i in range(0, len(batch), 64):
            part, pieces = batch.iloc[i : i + 64], []
            for packed, at in zip(part["packed"], part["at"], strict=True):
                data, p = unpack.decompress(packed), at >> 16
                pieces += [data[lo:hi] for lo, hi in zip((p - (at >> 8 & 255)).tolist(), (p - (at & 255) + LENGTH).tolist(), strict=True)]
            if pieces:
                yield pd.DataFrame({**{c: np.concatenate(part[c].tolist()) for c in ("anchor", "seg", "n", "crowded")}, "bytes": pieces})


def sort_shards(memory: int):
    """anchor, seg and the first and last start of each run of repeated windows, of rows in the order of their shards."""

    def flush(file, held: list[tuple]) -> Iterator[pd.DataFrame]:
        anchor, seg, alone, size = (np.concatenate(x) for x in zip(*held, strict=True))
        file.flush()
        text, limit = np.memmap(file, np.uint8, "r"), suffix_sort.Limit(memory)
        found = suffix_sort.repeated(text, memory)
        # A start with fewer bytes than LENGTH behind it in its piece is no window of it; nor do pieces with a count need marks.
        at = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        own = limit.array(len(text) + 1, np.int8)
        own[at[alone]] += 1
        own[(at + size - LENGTH + 1)[alone]] -= 1
        np.cumsum(own, dtype=np.int8, out=own)
        before, lo, hi = False, [], []
        for part in limit.slices(len(text)):
            hit = found[part] & (own[part] > 0)
            edge = np.diff(np.concatenate([[before], hit]).astype(np.int8))
            lo.append(np.flatnonzero(edge == 1) + part.start)
            hi.append(np.flatnonzero(edge == -1) + part.start - 1)
            before = hit[-1]
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        piece = np.searchsorted(at, lo, side="right") - 1
        for part in limit.slices(len(lo)):
            k = piece[part]
            yield pd.DataFrame({"anchor": anchor[k], "seg": seg[k], "lo": (lo[part] - at[k]).astype(np.int32), "hi": (hi[part] - at[k]).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held, now, last = None, [], None, pd.DataFrame({"anchor": [0], "seg": [0]})[:0]
        for batch in batches:
            # Rows that repeat an id and a text give the same piece twice.
            again = pd.concat([last, batch[["anchor", "seg"]]]).duplicated().to_numpy()[len(last) :]
            last, batch = batch[["anchor", "seg"]][-1:], batch[~again]
            for shard, pdf in batch.groupby("shard", sort=False):
                if shard != now:
                    if held:
                        yield from flush(file, held)
                    file, held, now = suffix_sort.scratch_file(), [], shard
                # UTF-8 has no 255: it becomes the separator.
                file.write((np.frombuffer(b"\xff".join(pdf["bytes"]) + b"\xff", np.uint8) + np.uint8(1)).tobytes())
                held.append((pdf["anchor"].to_numpy(), pdf["seg"].to_numpy(), pdf["n"].to_numpy() == 1, pdf["bytes"].str.len().to_numpy()))
        if held:
            yield from flush(file, held)

    return run


def cut_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            n = len(r.bytes) - LENGTH + 1
            yield pd.DataFrame({"anchor": r.anchor, "seg": r.seg, "n": r.n, "lo": np.arange(n, dtype=np.int32), "window": [xxhash.xxh3_128_digest(r.bytes[i : i + LENGTH]) for i in range(n)]})


def remove(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, rows = batch.iloc[i : i + 256], []
                for packed, marks in zip(part["packed"], part["marks"], strict=True):
                    data = unpack.decompress(packed)
                    n, removed, spans, kept = len(data), 0, 0, data
                    if marks is not None:
                        change = np.zeros(n + 1, np.int32)
                        np.add.at(change, marks >> 9, 1)
                        np.subtract.at(change, (marks >> 9) + (marks & 511) + LENGTH, 1)
                        gone = np.cumsum(change)[:-1] > 0
                        removed, spans = int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    rows.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if with_text else [])))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])])
                yield out.assign(id=part["id"].array)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, shard_bytes: int = SHARD_BYTES, with_text: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_text of every row.

    Removes each byte of a text's UTF-8 covered by a string of LENGTH bytes that also starts elsewhere, in the same
    text or another. A null text is empty. Rows that repeat id and text are repeats of each other. kept_text has
    replacement characters where a cut splits a character; kept_sha256 is that of the bytes. Other columns are ignored.
    A shard has shard_bytes, as far as a hash deals evenly; of its text, tuples and orders the sort holds ``memory``
    bytes, whatever the shard's size.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(named(id_col).alias("id")).dtypes)["id"]
    rows = docs.select(named(id_col).cast("string").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))  # ids pass pandas as text: next to a null, it would make long ones doubles
    often = rows.select("text").mapInPandas(all_anchors, "key long").groupBy("key").agg(F.count("*").alias("often")).filter("often > 1").select("key")
    met = stored(rows.mapInPandas(places(screen_of(often, SCREEN_MASK)), "anchor long, seg long, id string, tid long, at long"))
    segments = stored(met.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.first(F.struct("id", "tid", "at")).alias("r")).select("anchor", "seg", "n", "r.*"))
    size = F.expr(f"(at >> 8 & 255) - (at & 255) + {LENGTH}")
    mixed = segments.groupBy("anchor").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.min("n").alias("least"), F.sum(size + 1).alias("bytes")).filter("a < b AND least = 1")
    wanted = stored(segments.join(mixed.select("anchor", (F.col("bytes") > shard_bytes).alias("crowded")), "anchor").select("anchor", "seg", "id", "tid", "at", "n", "crowded"))
    total = wanted.filter("not crowded").agg(F.sum(size + 1)).first()[0] or 0
    shards = max(partitions(spark), -(-total // shard_bytes))

    # Both joins take the texts from one exchange: their keys and kind are the same.
    packed = rows.mapInPandas(squeeze, "id string, tid long, packed binary")
    with_texts = lambda marks: packed.join(marks, packed["id"].eqNullSafe(F.col("m_id")) & (packed["tid"] == F.col("m_tid")), "left")
    by_text = wanted.groupBy(F.col("id").alias("m_id"), F.col("tid").alias("m_tid")).agg(F.collect_list(F.struct("anchor", "seg", "at", "n", "crowded")).alias("w"))
    fields = ("anchor", "seg", "at", "n", "crowded")
    pieces = with_texts(by_text).select("packed", *(F.col("w").getField(c).alias(c) for c in fields)).mapInPandas(cut_segments, "anchor long, seg long, n long, crowded boolean, bytes binary")
    dealt = pieces.filter("not crowded").drop("crowded").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    in_shards = dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "anchor", "seg").mapInPandas(sort_shards(memory), "anchor long, seg long, lo int, hi int")
    windows = pieces.filter("crowded").dropDuplicates(["anchor", "seg"]).mapInPandas(cut_windows, "anchor long, seg long, n long, lo int, window binary")
    if not wanted.filter("crowded").isEmpty():
        windows = stored(windows)
        twice = windows.groupBy("window").agg(F.sum("n").alias("times")).filter("times > 1").select("window")
        in_shards = in_shards.unionByName(windows.filter("n = 1").join(twice, "window").select("anchor", "seg", "lo", F.col("lo").alias("hi")))
    whole = segments.filter("n > 1").select("anchor", "seg", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    runs = in_shards.unionByName(whole)
    first = F.expr("(at >> 16) - (at >> 8 & 255) + coalesce(lo, 0)")
    last = F.expr("CASE WHEN hi IS NULL THEN (at >> 16) - (at & 255) ELSE (at >> 16) - (at >> 8 & 255) + hi END")
    marks = met.join(runs, ["anchor", "seg"]).select("id", "tid", F.shiftleft(first, 9).bitwiseOR(last - first).alias("mark"))
    by_row = marks.groupBy(F.col("id").alias("m_id"), F.col("tid").alias("m_tid")).agg(F.collect_list("mark").alias("marks"))
    out = with_texts(by_row).select("id", "packed", "marks").mapInPandas(remove(with_text), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, " + ("kept_text string, " if with_text else "") + "id string")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[:-1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
