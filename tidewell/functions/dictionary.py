"""Dictionary extraction: the leftmost-longest terms of texts, with any number of terms in one pass over a text.

Texts and terms are sequences of words (runs of letters and digits, in lower case), so that a term is found only whole.
A vocabulary whose size, counted first, is within a bound goes to every task, which builds a trie of it once; a larger
one stays a table, which the texts' word sequences are joined with. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of terms up to which the vocabulary is sent to all tasks.
SEND_CHARS = 8_000_000


def words(c: Column) -> Column:
    """The words of a text, in order and in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class Trie:
    """An automaton over words: a node is a dictionary of the words that go on from it, and None holds its term."""

    def __init__(self, terms) -> None:
        self.root: dict = {}
        for term in terms:
            node = self.root
            for word in term.split(" "):
                node = node.setdefault(word, {})
            node[None] = term

    def found(self, text: list[str]) -> Iterator[tuple[int, int, str]]:
        """(place, words, term) of the leftmost-longest terms: the longest at a place, then on behind it."""
        at, n = 0, len(text)
        while at < n:
            node, i, best = self.root, at, None
            while i < n and (node := node.get(text[i])) is not None:
                i += 1
                if None in node:
                    best = (at, i - at, node[None])
            if best:
                yield best
                at += best[1]
            else:
                at += 1


def by_trie(texts: DataFrame, terms: list[str], kind: str) -> DataFrame:
    """texts: id, words."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("words").to_pylist()):
                here = list(trie.found(text or []))
                rows += [i] * len(here)
                found += here
            place, size, term = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(term, pa.string())], names=["id", "place", "size", "term"])

    return texts.mapInArrow(run, f"id {kind}, place int, size int, term string")


HIT = "struct<place:int,size:int,term:string>"


def by_join(texts: DataFrame, terms: DataFrame, sizes: list[int]) -> DataFrame:
    """texts: id, words. Word sequences of the terms' lengths meet the terms; a fold over a text's hits takes the leftmost-longest."""

    def of_size(n: int) -> Column:
        gram = lambda i: F.struct(i.alias("place"), F.lit(n).alias("size"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("term"))
        return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), gram)).otherwise(F.array().cast(f"array<{HIT}>"))

    grams = F.flatten(F.array(*map(of_size, sizes))) if sizes else F.array().cast(f"array<{HIT}>")
    hits = texts.select("id", F.xxhash64("words").alias("text"), F.inline(grams)).join(terms, "term")
    # A row has a hit once: how often it is there tells the rows that repeat an id and a text.
    hits = hits.groupBy("id", "text", "place", "size", "term").agg(F.count("*").alias("copies"))
    longest = hits.groupBy("id", "text", "place").agg(F.max_by(F.struct("place", "size", "term"), "size").alias("hit"), F.max("copies").alias("copies"))
    held = longest.groupBy("id", "text").agg(F.array_sort(F.collect_list("hit")).alias("hits"), F.max("copies").alias("copies"))  # a text's own places
    none = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{HIT}>").alias("kept"))
    step = lambda s, h: F.when(h["place"] >= s["next"], F.struct((h["place"] + h["size"]).alias("next"), F.array_append(s["kept"], h).alias("kept"))).otherwise(s)
    each = held.select("id", "hits", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select("id", F.inline(F.aggregate("hits", none, step, lambda s: s["kept"])))


def extract_terms(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, term_col: str = "term", send_chars: int = SEND_CHARS) -> DataFrame:
    """id_col, place (word number from 0), size (in words) and term of every leftmost-longest occurrence.

    ``vocabulary`` has a column of terms, which are compared by their words; equal ones count once, and one without words
    is no term. A null text has none. ids may repeat or be null: each row of texts has its occurrences.
    """
    terms = vocabulary.select(F.array_join(words(F.col(term_col)), " ").alias("term")).filter("term <> ''").distinct()
    texts = texts.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    chars = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if chars <= send_chars:
        found = by_trie(texts, [r["term"] for r in terms.collect()], dict(texts.dtypes)["id"])
    else:
        sizes = sorted(r["n"] for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())
        found = by_join(texts, terms, sizes)
    return found.select(F.col("id").alias(id_col), "place", "size", "term")
