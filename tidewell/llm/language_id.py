"""Language identification with a bit-sliced Bloom filter of n-grams.

Every slot of the filter is a bitmask of languages. An n-gram sets the bits of its languages in its slots; the AND of
its slots returns all languages that contain it at once. A text gets, for each language, the share of its n-grams with
that language's bit, less what the filter's false positives alone would give; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fold, named, read

#: Documents, in expectation, that the filter is fitted on; smaller corpora are used whole.
FIT_DOCS = 20_000
SLOTS, HASHES = 1 << 22, 3
LETTER = regex.compile(r"\p{L}")
#: Bytes of a text that are looked up at once.
PIECE = 1 << 18
#: ASCII other than letters becomes a space.
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

#: Languages, slots x ceil(languages / 8) bytes of language bits, and each language's rate of false positives.
Model = tuple[tuple[str, ...], np.ndarray, np.ndarray]


def grams(text: str) -> Iterator[np.ndarray]:
    """The 4-byte n-grams of a text, lower-cased, as numbers, PIECE at a time; runs of other ASCII are one space."""
    data = b" ".join([b"", *text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split(), b""]) + b"  "
    for at in range(0, len(data) - 3, PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - at), at).astype(np.uint32)
        yield b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def places(g: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return [((h >> np.uint64(21 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def shares(model: Model, text: str) -> np.ndarray:
    """The corrected share of each language, 0 to 1."""
    langs, masks, false_positives = model
    out, n = np.zeros(8 * masks.shape[1]), 0
    for g in grams(text):
        at = places(g)
        n += len(g)
        for byte in range(masks.shape[1]):
            column = masks[:, byte]
            counts = np.bincount(column[at[0]] & column[at[1]] & column[at[2]], minlength=256)
            for bit in range(8):
                out[8 * byte + bit] += counts[np.arange(256) >> bit & 1 == 1].sum()
    return np.clip((out[: len(langs)] / n - false_positives) / (1 - false_positives), 0, 1)


def build(langs: tuple[str, ...], words: pd.DataFrame) -> Model:
    """The filter of (byte, octet, bits): the bits of eight languages in eight consecutive slots."""
    masks = np.zeros((max(1, -(-len(langs) // 8)), SLOTS // 8), dtype="<i8")
    masks[words["byte"].to_numpy(), words["octet"].to_numpy()] = words["bits"].to_numpy()
    masks = np.ascontiguousarray(masks.view(np.uint8).T)
    fill = np.array([(masks[:, i // 8] >> i % 8 & 1).mean() for i in range(len(langs))])
    return langs, masks, np.minimum(fill**HASHES, 0.99)


def slot_bits(langs: tuple[str, ...]):
    """(byte, octet, bits) of the slots of every n-gram of (lang, text) rows."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                i, seen = number[lang], np.zeros(SLOTS, dtype=bool)
                for text in texts:
                    for g in grams(text):
                        for at in places(g):
                            seen[at] = True
                octets = np.packbits(seen.reshape(-1, 8), axis=1, bitorder="little")[:, 0]
                at = np.flatnonzero(octets)
                spread = np.unpackbits(octets[at][:, None], axis=1, bitorder="little").astype(np.uint8) << np.uint8(i % 8)
                yield pd.DataFrame({"byte": i // 8, "octet": at, "bits": spread.view("<i8")[:, 0]})

    return run


def fit(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, fit_docs: int = FIT_DOCS) -> Model:
    """Learn every n-gram of about ``fit_docs`` of the usable rows, drawn by a hash of the id.

    Rows with a null text or language are left out. What the driver gets is the filter: SLOTS bits a language at most.
    """
    rows = docs.filter(usable & named(lang_col).isNotNull() & named(text_col).isNotNull())
    share = min(1.0, fit_docs / max(1, docs.count()))
    drawn = rows.filter(F.pmod(F.xxhash64(named(id_col)), F.lit(1 << 20)) < int(share * (1 << 20))).select(named(lang_col).alias("lang"), named(text_col).alias("text"))
    langs = tuple(sorted(r["lang"] for r in drawn.select("lang").distinct().collect()))
    words = drawn.mapInPandas(slot_bits(langs), "byte int, octet int, bits long").groupBy("byte", "octet").agg(F.bit_or("bits").alias("bits"))
    return build(langs, words.toPandas())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, lang_pred and score of every row.

    A null text and one without a letter (a character of a Unicode category L) are ``und`` with score 0, as is every
    text if nothing was learned. Of equal shares the first language in text order wins. Repeated rows each get their
    row; other columns are never read. A very long text is looked up in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            out = []
            for text in texts:
                if text is None or not model[0] or not LETTER.search(text):
                    out.append(("und", 0.0))
                else:
                    found = shares(model, text)
                    out.append((model[0][int(found.argmax())], float(found.max())))
            yield pd.DataFrame(out, columns=["lang", "score"])

    kept = [named(c) for c in (id_col, *keep)]
    found = docs.select(*kept, predict(named(text_col)).alias("found"))
    return found.select(*kept, F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = fit(docs, ~F.col("held_out"), "doc_id", "text", "lang")
    return identify(docs, model, keep=("held_out",))
