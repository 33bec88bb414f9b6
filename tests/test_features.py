"""Index, dictionary, ranking, matching, assignment and state operators against brute force and step-by-step versions."""

from __future__ import annotations

import datetime
import heapq
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from functools import cache, reduce
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import dictionary, text
from tidewell.operators import assignment, fuzzy, retrieval, text_rank, vector_index
from tidewell import plans
from tidewell.plans import sql_functions
from tidewell.sources import files
from tidewell.streaming import conversations, retro, stores

LARGE, SMALL = Path("/root/testdata/sf0.1"), Path("/root/testdata/sf0.001")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, v) for v in r))


# Vectors


def cosines(vectors, k, queries):
    unit = {i: (v / np.linalg.norm(v) if np.linalg.norm(v) else v) for i, v in vectors.items()}
    out = []
    for q in queries:
        best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in vectors if i != q)[:k]
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    return {i: np.round(centres[i % 6] + 0.3 * rng.normal(size=8), 3) for i in range(300)} | {400: np.zeros(8), 450: np.ones(8)}


@pytest.mark.parametrize(("lists", "queries"), [(8192, 1024), (9, 2)])
def test_vector_index_exact(spark, vectors, monkeypatch, lists, queries):
    monkeypatch.setattr(vector_index, "LIST_ROWS", lists)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", queries)
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id % 25 = 0 AND id < 450")
    for cells in (None, 1, 40):
        index = vector_index.build(df, "id", "v", cells=cells)
        assert sum(index.cells["n"]) == len(vectors)
        got = vector_index.search(index, asked, 7, "id", "v", probes=2, exact=True).withColumn("score", F.round("score", 6))
        assert rows_of(got) == cosines(vectors, 7, [q for q in vectors if q % 25 == 0 and q < 450])
    empty = vector_index.build(df.limit(0), "id", "v")
    assert vector_index.search(empty, asked, 7, "id", "v", exact=True).count() == 0


@pytest.mark.skipif(not LARGE.exists(), reason="no test tables here")
def test_vector_index_recall(spark):
    e = spark.read.parquet(str(LARGE / "embeddings.parquet")).select("vec_id", "embedding")
    index = vector_index.build(e, "vec_id", "embedding")
    q = e.filter("vec_id % 50 = 0")
    exact = retrieval.knn(q.select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv")), 10, "query", "qv", "doc", "dv")
    probes = vector_index.probes_for(index, e.filter("vec_id % 50 = 25"), 10, "vec_id", "embedding")
    assert 1 <= probes < len(index.centroids)
    found = vector_index.search(index, q, 10, "vec_id", "embedding", probes=probes)
    assert vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("send", [1000, 0])
def test_nearest_within_a_category(spark, vectors, monkeypatch, send):
    monkeypatch.setattr(retrieval, "SEND_QUERIES", send)
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    df = spark.createDataFrame([(i, [float(x) for x in v], "a" if i % 3 else None) for i, v in vectors.items()], "id long, v array<double>, c string")
    q = df.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("c").alias("qc"))
    got = retrieval.knn(q, df.withColumnsRenamed({"id": "d", "v": "dv", "c": "dc"}), 5, "q", "qv", "d", "dv", within=("qc", "dc"))
    want = []
    for group in ([i for i in vectors if i % 3], [i for i in vectors if not i % 3]):
        want += cosines({i: vectors[i] for i in group}, 5, [i for i in group if i % 50 == 0])
    assert rows_of(got.withColumn("score", F.round("score", 6))) == sorted(want)


def test_nearest_by_a_scan(spark, monkeypatch):
    """Queries in arrays find what those in rows do, bit by bit: copies, ties, nulls and all; and tasks give k rows of each at most."""
    rng = random.Random(10)
    kinds = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(9)] + [[0.0] * 7, [float("nan")] * 7, None, [1.0, 2.0], []]
    rows = [(i, rng.choice(kinds[:10]) if i % 3 else [rng.uniform(-1, 1) for _ in range(7)]) for i in range(300)]
    rows += [(300 + i, v) for i, v in enumerate(kinds[11:])] + [(None, [1.0] * 7)]

    def found(rows):
        df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
        q = df.filter("id % 5 = 0 OR id >= 300").select(F.col("id").alias("query"), F.col("v").alias("qv"))
        out = retrieval.knn(q, df.select(F.col("id").alias("doc"), "v"), 4, "query", "qv", "doc", "v").collect()
        return sorted((r["query"], r["rank"], r["doc"], repr(r["score"] and r["score"] + 0.0)) for r in out)

    tables = (rows, [*rows, (400, [float("nan")] * 7)], rows[:2] + rows[-4:])
    sent = [found(r) for r in tables]
    given, plain = [], retrieval.scores_of_block
    monkeypatch.setattr(retrieval, "scores_of_block", lambda *a: given.append((len(a[0]), plain(*a))) or given[-1][1])
    monkeypatch.setattr(retrieval, "SEND_QUERIES", 0)
    for block, cells in ((10_000, 4_000_000), (20, 90)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert [found(r) for r in tables] == sent
    assert len(sent[0]) == 63 * 4 and given[0][1].count() <= 3 * 4 * given[0][0]


# Dictionary


def leftmost_longest(words, terms):
    out, at = [], 0
    while at < len(words):
        size = max((n for n in range(1, len(words) - at + 1) if " ".join(words[at : at + n]) in terms), default=0)
        if size:
            out.append((at, size, " ".join(words[at : at + size])))
        at += size or 1
    return out


def test_dictionary_terms(spark):
    rng = random.Random(2)
    letters = ["a", "b", "C", "é", "日本"]
    make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    terms = [make(rng.randint(1, 4)) for _ in range(40)] + ["", None, " - ", "a,b", "never there"]
    texts = [(i, make(rng.randint(0, 60)).replace("a b", "a - b")) for i in range(50)] + [(50, None), (51, ""), (3, "a b C"), (None, make(30))]
    texts += [texts[4], texts[4]]
    known = {" ".join(w for w in (t or "").lower().replace(",", " ").replace("-", " ").split()) for t in terms} - {""}
    want = [(i, *hit) for i, t in texts for hit in leftmost_longest((t or "").lower().replace("-", " ").split(), known)]
    df, v = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for send in (dictionary.SEND_CHARS, 0):
        assert rows_of(dictionary.extract_terms(df, v, "id", "text", send_chars=send)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
        assert dictionary.extract_terms(df, v.limit(0), "id", "text", send_chars=send).count() == 0


# Text rank


def cover_rank(words, terms):
    hits = [(i, w) for i, w in enumerate(words) if w in terms]
    spans = [(a, b) for a in range(len(hits)) for b in range(a, len(hits)) if {w for _, w in hits[a : b + 1]} == set(terms)]
    covers = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    return sum(0.1 / (1 + hits[b][0] - hits[a][0] - (b - a)) for a, b in covers)


def test_text_rank_and_hybrid(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["fee", "card", "lost", "the", "limit", "pay"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))), [rng.gauss(0, 1) for _ in range(4)] if i % 3 else None, rng.choice("ab")) for i in range(90)]
    docs += [(90, None, None, None), (91, "Fee, CARD; lost!", None, "a")]
    queries = [(i, t, v, c) for i, t, v, c in [(0, ["fee", "card"], [1.0, 0.0, 0.0, 0.0], "a"), (1, ["lost"], None, "b"), (2, [], [0.0, 1.0, 0.0, 0.0], "a"), (3, ["fee", "absent"], [0.0, 0.0, 1.0, 0.0], "a"), (4, ["fee", "card", "lost", "the"], [0.0, 0.0, 1.0, 1.0], "z"), (5, ["absent"], None, "a")]]
    d = spark.createDataFrame(docs, "doc long, text string, vector array<double>, category string")
    q = spark.createDataFrame(queries, "query long, terms array<string>, vector array<double>, category string")
    index = text_rank.positional_index(d, "doc", "text")
    words = {i: (t or "").lower().replace(",", "").replace(";", "").replace("!", "").split() for i, t, _, _ in docs}
    ranks = {(i, n): cover_rank(w, terms) for i, terms, _, _ in queries for n, w in words.items() if terms and set(terms) <= set(w)}
    assert {(r["query"], r["doc"]): round(r["rank"], 9) for r in text_rank.text_rank(index, q).collect()} == {k: round(v, 9) for k, v in ranks.items()}
    assert any(v > 0.2 for v in ranks.values())

    want = []
    for i, _, v, c in queries:
        found = []
        for n, _, w, g in docs:
            if n != i and ((i, n) in ranks or (v and w)):
                near = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) if v and w else 0.0
                found.append((g == c, -round(0.8 * near + 0.2 * min(ranks.get((i, n), 0), 1), 9), n))
        found = [x for x in found if x[0]] or found
        want += [(i, n, r) for r, (_, _, n) in enumerate(sorted(x[1:] and (0, *x[1:]) for x in found)[:6], 1)]
    got = text_rank.hybrid(q, d, index, 6).select("query", "doc", "rank")
    assert rows_of(got) == sorted(want)


def test_text_rank_by_a_scan(spark, monkeypatch):
    """A scan gives what the index gives, in blocks of queries too, and within a category only its documents."""
    rng = random.Random(6)
    vocabulary = ["fee", "card", "lost", "the", "limit", "pay"]
    docs = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))], rng.choice(["a", "b", None])) for i in range(120)] + [(120, None, "a")]
    queries = [(i, rng.sample([*vocabulary, "absent"], rng.randint(0, 4)), rng.choice(["a", "b", None, "z"])) for i in range(40)]
    d = spark.createDataFrame(docs, "doc long, words array<string>, category string")
    q = spark.createDataFrame(queries, "query long, terms array<string>, category string")
    index = text_rank.positional_index(d.select("doc", F.array_join("words", " ").alias("text")), "doc", "text")
    whole = rows_of(text_rank.text_rank(index, q).select("query", "doc", F.round("rank", 9)))
    of = ({i: c for i, _, c in queries}, {i: c for i, _, c in docs})
    assert len(whole) > 100
    for most in (100_000, 7):
        monkeypatch.setattr(text_rank, "SEND_QUERIES", most)
        assert rows_of(text_rank.scan_rank(d, q).select("query", "doc", F.round("rank", 9))) == whole
        assert rows_of(text_rank.scan_rank(d, q, within=True).select("query", "doc", F.round("rank", 9))) == [r for r in whole if of[0][r[0]] == of[1][r[1]]]
    assert text_rank.scan_rank(d, q.limit(0)).count() == 0


def test_words_of_texts_at_once(spark):
    """Texts split in numpy have the words that the expression over a column gives."""
    rng = random.Random(3)
    odd = [*"aZ09 .-_\n", "é", "İ", "ΑΣ", "ß", "²", "Ⅷ", "٣", "日本", "\u0301", "😀", "𝒜", "𐐷", "𠀀", "\U000e0101", "\uffff", "\x00"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "x", "é", " "]
    d = spark.createDataFrame(enumerate(texts), "id long, text string")
    want = [r["w"] or [] for r in d.select("id", dictionary.words(F.col("text")).alias("w")).orderBy("id").collect()]
    lower = pa.array([r["t"] for r in d.select("id", F.lower("text").alias("t")).orderBy("id").collect()], pa.string())
    letter = text_rank.letters(spark)
    for at, n in ((0, len(texts)), (7, 100), (300, 2), (len(texts) - 1, 1)):
        words, sizes = text_rank.split(lower.slice(at, n), letter)
        ends = np.cumsum(sizes)
        assert [words.to_pylist()[e - s : e] for s, e in zip(sizes, ends, strict=True)] == want[at : at + n]


def test_bounds_of_text_ranks():
    """No rank exceeds its bound, and for two terms of which one is there once and far from others, the bound is near it."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 200, 60)
    numbers = np.minimum(rng.zipf(1.4, sizes.sum()), 40) - 1
    found = text_rank.Postings(np.where(numbers < 39, numbers, -1), sizes, 39)
    counts, at = found.counts(np.arange(60))
    sets = np.array([[*rng.choice(12, m, replace=False), *[39] * (4 - m)] for m in rng.integers(1, 5, 300)])
    some, rows = np.nonzero(np.min([counts[at[sets[:, t]]] for t in range(4)], axis=0))
    runs = found.runs(rows, sets[some])
    bounds, ranks = found.bounds(*runs), found.ranks(*runs)
    assert len(ranks) > 1_000 and 100 < np.isfinite(bounds).sum() < len(bounds)
    assert (bounds >= ranks - 1e-12).all() and np.median((bounds / ranks)[np.isfinite(bounds)]) < 5
    words = np.array([1] * 30 + [-1] * 9 + [0] + [-1] * 19 + [1] * 30)
    one = text_rank.Postings(words, np.array([len(words)]), 2)
    runs = one.runs(np.array([0]), np.array([[0, 1]]))
    assert one.bounds(*runs)[0] == pytest.approx(2 * 0.1 / 10) and one.ranks(*runs)[0] == pytest.approx(0.1 / 10 + 0.1 / 20)


def test_combined_by_a_scan(spark, monkeypatch):
    """Text rank and vectors together against brute force, in blocks and small steps, with bounds first; tasks give only the best of theirs."""
    rng = random.Random(12)
    vocabulary = ["fee", "card", "lost", "the", "limit", "päy", *"abcdefgh"]
    docs = [(i, " ".join(rng.choices(vocabulary, [9, 7, 5, 9, 3, 2] + [0.3] * 8, k=rng.randint(0, 24))), [round(rng.gauss(0, 1), 1) for _ in range(4)] if i % 3 == 0 else None, rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    docs += [(400 + i, "The FEE, the card; " * 6, [1.0, 0.0, 0.0, 0.0], "a") for i in range(20)] + [(420 + i, "lost fee", None, "b") for i in range(20)]
    docs += [(440, None, None, None), (441, None, [0.0] * 4, "a"), (442, "fee only", [], "c"), (443, "rare here", None, "c"), (444, "rare there", None, "a")]
    docs += [(445, "odd", [float("nan"), 1.0, 0.0, 0.0], "b"), (446, "odd one", [float("inf"), 1.0, 0.0, 0.0], "d"), (447, "odd fee", [None, 1.0, 0.0, 0.0], "a"), (448, "fee", [1.0, 2.0], "a"), (449, None, [-1.0, -2.0, 0.0, 0.5], "d"), (450, "odd", [-1.0, 0.0, 0.0, 0.5], "d"), (451, "a", [1.0, 2.0, 3.0, 4.0], "d")]
    at = lambda i: i - 100 * (i >= 400)
    queries = [(i, sorted({*(docs[at(i)][1] or "").lower().replace(",", "").replace(";", "").split()[:3]}), *docs[at(i)][2:]) for i in range(0, 440, 5) if i < 300 or i >= 400]
    queries += [(443, ["rare"], None, "c"), (500, ["rare"], None, "z"), (501, [], [1.0, 0.0, 0.0, 0.0], "z"), (502, ["absent"], None, "a"), (503, [], None, "a"), (504, ["lost", "absent"], [0.0, 1.0, 0.0, 0.0], None), (505, ["fee"], [0.0] * 4, "a"), (442, ["fee", "only"], [], "c"), (506, None, None, "a")]
    queries += [(446, ["odd", "one"], [float("inf"), 1.0, 0.0, 0.0], "d"), (447, ["odd", "fee"], [None, 1.0, 0.0, 0.0], "a"), (448, ["fee"], [1.0, 2.0], "a"), (507, ["odd"], [-1.0, -2.0, 0.0, 0.5], "d"), (508, ["fee"], [float("nan")] * 4, "b")]
    dot = lambda x, y: reduce(add, (i * j for i, j in zip(x, y, strict=True)), 0.0)

    @cache
    def rank_of(words, terms):
        hits, last, begun, rank = [(i, w) for i, w in enumerate(words) if w in terms], {}, -1, 0.0
        for i, (place, w) in enumerate(hits):
            last[w] = i
            if len(last) == len(terms) and min(last.values()) > begun:
                begun = min(last.values())
                rank += 0.1 / (1 + place - hits[begun][0] - (i - begun))
        assert round(rank, 9) == round(cover_rank(words, terms), 9)
        return rank

    want = []
    words = {i: (t or "").lower().replace(",", "").replace(";", "").split() for i, t, _, _ in docs}
    for i, terms, v, c in queries:
        found = []
        for n, _, u, g in docs:
            text = rank_of(tuple(words[n]), frozenset(terms)) if terms and {*terms} <= {*words[n]} else None
            if n != i and (text is not None or (v is not None and u is not None)):
                norm = dot(v, v) ** 0.5 * dot(u, u) ** 0.5 if v and u and len(v) == len(u) and None not in [*v, *u] else 0
                near = dot(v, u) / norm if norm else 0.0
                found.append((g != c, -math.inf if math.isnan(near) else -((1 - 0.2) * near + 0.2 * min(text or 0, 1)), n, round(text or 0, 6)))
        found = [x for x in found if not x[0]] or found
        want += [(i, n, text, None if s == -math.inf else round(-s, 6), r) for r, (_, s, n, text) in enumerate(sorted((False, *x[1:]) for x in found)[:6], 1)]
    d = spark.createDataFrame([(i, t, g) for i, t, _, g in docs], "doc long, text string, category string").repartition(3).localCheckpoint()
    v = spark.createDataFrame([(i, u) for i, _, u, _ in docs if u is not None or i % 2], "doc long, vector array<double>")
    q = spark.createDataFrame(queries, "query long, terms array<string>, vector array<double>, category string")
    given, plain = [], text_rank.top_per_group
    monkeypatch.setattr(text_rank, "top_per_group", lambda df, *a: given.append(df) or plain(df, *a))
    for seed_from, most, cells, hits, part in ((10_000, 100_000, 4_000_000, 500_000, 4_000_000), (1, 30, 300, 50, 900)):
        for name, value in (("SEED_FROM", seed_from), ("SEED_PART", 3), ("SEND_QUERIES", most), ("HITS", hits), ("SLICE", part)):
            monkeypatch.setattr(text_rank, name, value)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = text_rank.scan_combined(q, d, v, 6).select("query", "doc", F.round("text", 6), F.when(~F.isnan("score"), F.round("score", 6)), "rank")
        assert rows_of(got) == sorted(want)
    per_task = given[0].groupBy(F.spark_partition_id(), "key").count()
    assert given[0].count() > 500 and per_task.filter("count > 7").count() == 0
    assert len(given) == 7 and sum(df.count() for df in given[2::2]) < 0.7 * given[0].count()  # with bounds from one of three documents, the rest give few
    assert text_rank.scan_combined(q.limit(0), d, v, 6).count() == 0


def test_overlap_by_a_scan(spark, monkeypatch):
    """The best by words in common against brute force, with ties, copies, blocks of queries and small steps; tasks give few rows."""
    rng = random.Random(9)
    vocabulary = [*"abcdefgh", "the"]
    docs = [(i, sorted({"the", *rng.choices(vocabulary, k=rng.randint(1, 9))}) if i % 7 else [], i % 11) for i in range(400)]
    docs += [(400, None, 0), (401, [], 0), (None, ["the"], 0), (402, [f"w{i}" for i in range(640_000)] + ["the"], 0), (403, [f"w{i}" for i in range(640_001)] + ["a"], 0), (404, ["w1", "z"], 0), (405, ["z"], 0)]
    queries = [(i, rng.sample([*vocabulary, "absent"], rng.randint(0, 3))) for i in range(60)] + [(500, ["the"]), (501, ["w5"]), (405, ["z"])]
    d = spark.createDataFrame([r[:2] for r in docs], "doc long, words array<string>").repartition(3).localCheckpoint()
    q = spark.createDataFrame(queries, "query long, terms array<string>")
    want = []
    texts = [(n, {*w}) for n, w, _ in docs if n is not None and w]
    for i, terms in queries:
        scored = [(-round(len(w & {*terms}) / len(w) ** 0.5, 9), n) for n, w in texts if n != i and w & {*terms}]
        want += [(i, n, round(-s, 6), r) for r, (s, n) in enumerate(sorted(scored)[:5], 1)]
    given, plain = [], text_rank.overlap_block
    monkeypatch.setattr(text_rank, "overlap_block", lambda *a: given.append(plain(*a)) or given[-1])
    for most, cells in ((100_000, 4_000_000), (30, 50)):
        monkeypatch.setattr(text_rank, "SEND_QUERIES", most)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert rows_of(text_rank.scan_overlap(d, q, 5).select("query", "doc", F.round("score", 6), "rank")) == sorted(want)
    sets = len({frozenset(t) for _, t in queries if t})
    assert len(given) > 2 and given[0].count() <= 6 * 3 * sets
    assert text_rank.scan_overlap(d, q.limit(0), 5).count() == 0


def test_compound_split(spark):
    rng = random.Random(1)
    known = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) for _ in range(12)] + ["x", "longest"]
    terms = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(60)] + [known[0], known[0] + known[1], "", None, "xx", known[2] + "longest"]

    def best(term):
        splits = []

        def go(at, parts):
            if at == len(term):
                splits.append(parts)
            for k in known:
                if len(k) >= 2 and term.startswith(k, at) and len(k) < len(term):
                    go(at + len(k), [*parts, k])

        go(0, [])
        return min(splits, key=lambda p: (len(p), [-len(x) for x in reversed(p)])) if splits else None

    want = sorted((t, best(t)) for t in set(terms) if t and best(t))
    df, index = spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(k,) for k in known], "term string")
    assert sorted(map(tuple, retrieval.split_compounds(df, index).collect())) == want


def test_lookup_or_split(spark):
    index = spark.createDataFrame([("lost", 1, 1.0), ("card", 1, 0.5), ("card", 2, 1.0), ("fee", 3, 0.7)], "term string, doc long, relevance double")
    asked = spark.createDataFrame([(1, "lostcard"), (2, "card"), (3, "cardfee"), (4, "nothing")], "query int, term string")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.lookup_or_split(index, asked).collect()}
    assert got == {(1, 1): 0.75, (2, 2): 1.0, (2, 1): 0.5, (3, 1): 0.5, (3, 2): 1.0, (3, 3): 0.7}


# Names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def apart(s):
    initial = dict(zip((chr(0x1100 + i) for i in range(19)), text.INITIALS, strict=True))
    final = dict(zip((chr(0x11A8 + i) for i in range(27)), text.FINALS, strict=True))
    vowel = {chr(0x1161 + i): chr(0x314F + i) for i in range(21)}
    table = initial | final | vowel
    return "".join("".join(table[x] for x in unicodedata.normalize("NFD", c)) if 0xAC00 <= ord(c) <= 0xD7A3 else c for c in s)


def test_letters_and_sounds(spark):
    rng = random.Random(7)
    syllable = lambda: chr(rng.choice([0xAC00, 0xD7A3, rng.randint(0xAC00, 0xD7A3)]))
    texts = ["".join(rng.choice([syllable(), syllable(), "a", "B", " ", "é", "힣", "ㄱ"]) for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["", "푸른하늘", "부른 하늘"]
    pairs = [(a, rng.choice(texts)) for a in texts] + [("푸른하늘", "부른 하늘"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.letters(F.col("a")).alias("l"), text.sound_similarity(F.col("a"), F.col("b")).alias("s"))
    for a, b, got, s in df.collect():
        if a is None:
            assert got is None and s is None
            continue
        x, y = (apart("".join(t.split()).lower()) for t in (a, b))
        assert got == apart(a)
        assert s == pytest.approx(1 - edits(x, y) / max(len(x), len(y)) if x or y else 1.0)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize(("scorer", "least"), [("weighted", 85.0), ("partial", 78.0), ("weighted", 78.0)])
def test_fuzzy_matches(spark, monkeypatch, scorer, least):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    terms = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)] + ["ab", "", None, "ÀBC d", "  abc  "]

    def typo(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], " ".join(reversed(s.split())), s + " and more of it", s])

    asked = list(enumerate([typo(t or "zz") for t in terms for _ in range(3)] + [None, "", "a"]))
    q, c = spark.createDataFrame(asked, "query long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for a, b in [(rng.choice(terms) or "", rng.choice(words)) for _ in range(200)]:
        assert fuzzy.common(a, b) == brute_lcs(a, b)
    plain = {t: t.strip().lower() for t in terms if t is not None}
    want = []
    for i, s in asked:
        s = (s or "").strip().lower()
        found = sorted((-fuzzy.SCORERS[scorer](s, n), t) for t, n in plain.items() if len(n) >= 3 and len(s) >= 3)
        want += [(i, t, round(-x, 6), r) for r, (x, t) in enumerate([f for f in found if -f[0] >= least][:3], 1)]
    got = fuzzy.fuzzy_matches(q, c, least, scorer).withColumn("score", F.round("score", 6))
    assert rows_of(got) == sorted(want) and len(want) > 60
    with pytest.raises(ValueError, match="78"):
        fuzzy.fuzzy_matches(q, c, 70.0)


# Texts


def test_character_alignment(spark):
    turns = lambda rows, c=1: [(c, i, r, t) for i, (r, t) in enumerate(rows)]
    schema = "conv_id long, turn long, role string, text string"
    said = turns([("agent", "good morning how can I help you today"), ("user", "my card is lost"), ("user", None), (None, "ok")]) + turns([("user", "only here")], 2)
    heard = turns([("agent", "good mornin how can I help"), ("agent", " you today"), ("user", "my cart is lost ok")]) + turns([("user", "only there")], 3)
    a, b = spark.createDataFrame(said, schema), spark.createDataFrame(heard, schema)
    rows = conversations.character_alignment(a, b).orderBy("start").collect()
    one = ["".join(r[3] or "" for r in x if r[0] == 1) for x in (said, heard)]
    roles = [[r[2] or "" for r in x if r[0] == 1 for _ in r[3] or ""] for x in (said, heard)]
    assert rows and all(r["conv_id"] == 1 for r in rows)
    for r in rows:  # what is aligned is equal, in order, and of one turn and role on both sides
        assert one[0][r["start"] : r["end"]] == one[1][r["heard_start"] : r["heard_end"]]
        assert set(roles[0][r["start"] : r["end"]]) == {r["role"]} and set(roles[1][r["heard_start"] : r["heard_end"]]) == {r["heard"]}
    assert all(x["end"] <= y["start"] and x["heard_end"] <= y["heard_start"] for x, y in zip(rows, rows[1:], strict=False))
    aligned = sum(r["end"] - r["start"] for r in rows)
    assert aligned >= len(one[0]) - 3
    correct = sum(r["end"] - r["start"] for r in rows if r["role"] == r["heard"])
    got = {r["conv_id"]: (r["characters"], r["aligned"], r["correct"]) for r in conversations.alignment_accuracy(a, conversations.character_alignment(a, b)).collect()}
    assert got == {1: (len(one[0]), aligned, correct), 2: (len("only here"), 0, 0)}


def test_mismatch_spans(spark):
    """The same words with other roles: each run of wrong turns is a span."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice("ab"), "x" * rng.randint(0, 30) + str(t)) for c in range(6) for t in range(12)]
    other = [(c, t, "b" if rng.random() < 0.4 else r, x) for c, t, r, x in rows]
    schema = "conv_id long, turn long, role string, text string"
    aligned = conversations.character_alignment(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema))
    want = []
    for c in range(6):
        wrong = "".join(("1" if a[2] != b[2] else "0") * len(a[3]) for a, b in zip(rows, other, strict=True) if a[0] == c)
        at = 0
        while at < len(wrong):
            end = at
            while end < len(wrong) and wrong[end] == wrong[at]:
                end += 1
            if wrong[at] == "1" and end - at >= 20:
                want.append((c, at, end - at))
            at = end
    assert rows_of(conversations.mismatch_spans(aligned, 20).select("conv_id", "start", "characters")) == want and len(want) >= 5


def test_alignment_by_runs(monkeypatch):
    """Equal runs are difflib's, with few pairs held too; of long texts only short stretches are left to difflib."""
    rng = random.Random(4)
    plain, met = conversations.SequenceMatcher, []
    monkeypatch.setattr(conversations, "SequenceMatcher", lambda _, a, b, autojunk: met.append(len(a) * len(b)) or plain(None, a, b, autojunk=autojunk))
    for k in range(600):
        monkeypatch.setattr(conversations, "RUN_PAIRS", 1 if k % 3 == 0 else 64)
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        b = [rng.choice(letters) if rng.random() < 0.1 else x for x in a if rng.random() < 0.9]
        assert conversations.matching_blocks(a, b) == [tuple(m) for m in plain(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    said = [f"w{rng.randint(0, 300)}" for _ in range(3000)]
    heard = [w for w in said if rng.random() < 0.9]
    met.clear()
    found = conversations.aligned_places(" ".join(said), " ".join(heard))
    assert sum(n for _, _, n in found) > 0.98 * len(" ".join(heard)) and max(met) < 2000
    met.clear()
    assert conversations.aligned_places(" ".join(said), " ".join(said)) == [(0, 0, len(" ".join(said)))] and not met


def test_overlap_corrections_and_repeats(spark):
    df = spark.createDataFrame([(["one\ntwo", "three\nfour\nfive", "six"],), (["a" * 50, "b"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(text.overlapping(F.col("c"), 10)).collect()] == [["one\ntwo", "one\ntwo\nthree\nfour\nfive", "four\nfive\nsix"], ["a" * 50, "b"], []]
    assert [r[0] for r in df.select(text.overlapping(F.col("c"), 4)).collect()][0] == ["one\ntwo", "two\nthree\nfour\nfive", "five\nsix"]
    t = spark.createDataFrame([("red [RED] red",), ("[RED]",), ("red",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(text.correct_outside(F.col("t"), {"red": "blue"}, r"\\[[A-Z]+\\]")).collect()] == ["blue [RED] blue", "[RED]", "blue", "", None]
    p = spark.createDataFrame([(["a", "", "b", "A", "", "a"],), ([],)], "p array<string>")
    assert [r[0] for r in p.select(text.first_of_equals(F.col("p"), F.lower)).collect()] == [["a", "", "b", ""], []]


def test_nearest_cells_in_parts(monkeypatch):
    """Distances are held for a few vectors at once, and the cells are those of all at once."""
    rng = np.random.default_rng(3)
    v, centroids = rng.normal(size=(1000, 8)), rng.normal(size=(50, 8))
    held, plain = [], np.argsort
    monkeypatch.setattr(vector_index.np, "argsort", lambda d, **k: held.append(len(d)) or plain(d, **k))
    got = {n: vector_index.nearest_cells(v, centroids, n) for n in (1, 7, 50)}
    assert max(held) <= 256
    want = plain((centroids**2).sum(axis=1)[None, :] - 2 * (v @ centroids.T), axis=1, kind="stable")
    assert all((got[n] == want[:, :n]).all() for n in got) and vector_index.nearest_cells(v[:0], centroids, 7).shape == (0, 7)


def test_texts_are_read_once(spark):
    """Letters of a text, and the chunks that overlap, are worked out once, however often they are read."""
    df = spark.createDataFrame([("ab", "ba")], "a string, b string")
    plan = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(text.sound_similarity(F.upper("a"), F.upper("b"))).count("upper(a#") == 1
    assert plan(text.overlapping(F.split("a", "-"), 10)).count("split(a#") == 1


def test_syllables(spark):
    got = [r[0] for r in spark.range(text.SYLLABLES).select(text.syllable(F.col("id"))).collect()]
    assert got == [chr(text.FIRST_SYLLABLE + i) for i in range(text.SYLLABLES)]


def test_repeats_by_a_key_with_options(spark):
    """trim takes characters beside the text: a line's number is none of them."""
    p = spark.createDataFrame([(["call 10", " 1 at 1", "1 at 1 ", "call 10"],)], "p array<string>")
    assert [r[0] for r in p.select(text.first_of_equals(F.col("p"), F.trim)).collect()] == [["call 10", " 1 at 1"]]


def test_seeded_choices(spark):
    df = spark.range(20_000)
    share = {r["k"]: r["count"] / 20_000 for r in df.select(text.weighted_choice({"a": 0.4, "b": 0.35, "c": 0.25}, 3, "id").alias("k")).groupBy("k").count().collect()}
    assert share == pytest.approx({"a": 0.4, "b": 0.35, "c": 0.25}, abs=0.02)
    tiers = [("few", 40, 1), ("some", 35, 3), ("many", 18, 6), ("most", 7, 12)]
    for total in (0, 100, 3333, 500):
        got = assignment.tiered_counts(spark.range(101), "id", tiers, total, 1).collect()
        assert len(got) == 101 and sum(r["calls"] for r in got) == total
    days = spark.sql("SELECT date'2024-01-07' AS d")
    assert [str(r[0]) for r in text.last_weekdays(days, "d", 3).collect()] == ["2024-01-05", "2024-01-04", "2024-01-03"]


def test_resumed_load(spark, tmp_path):
    df = spark.range(40).withColumn("step", F.col("id") % 4)
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    files.resume(df, path, progress, "step", stop_after=2)
    assert spark.read.parquet(path).count() == 20
    df.filter("step = 2").limit(3).write.mode("append").partitionBy("step").parquet(path)  # written, but not noted
    files.resume(df, path, progress, "step")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(40))
    files.resume(df, path, progress, "step")
    assert spark.read.parquet(path).count() == 40


def test_line_packing_and_two_passes(spark):
    lexical = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (2, 12, 0.9, 1), (2, 13, 0.85, 2), (3, 14, 0.1, 1)], "query long, doc long, score double, rank int")
    vector = spark.createDataFrame([(q, d, r) for q in (1, 2, 3, 4) for r, d in ((1, 12), (2, 20))], "query long, doc long, rank int")
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "query long")
    got = [(r["query"], r["doc"], r["place"]) for r in retrieval.two_passes(queries, lexical, vector, 0.35, 0.08).orderBy("query", "place").collect()]
    assert got == [(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2), (2, 20, 3), (3, 14, 1), (3, 12, 2), (3, 20, 3), (4, 12, 1), (4, 20, 2)]


# Assignment


@pytest.mark.parametrize(("loads", "n"), [([3, 0, 7, 7, None, 1], 40), ([3, 0, 7, 7, None, 1], 2), ([0] * 5, 13), ([100, 1], 5), ([4], 3), ([], 3), ([1, 2], 0)])
def test_least_loaded(spark, loads, n):
    agents = spark.createDataFrame([(i, x) for i, x in enumerate(loads)], "agent long, load long")
    items = spark.createDataFrame([(i,) for i in range(n)], "item long")
    heap = [(x or 0, x or 0, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    want = []
    for i in range(n if loads else 0):
        now, first, a = heapq.heappop(heap)
        want.append((i, a))
        heapq.heappush(heap, (now + 1, first, a))
    got = assignment.least_loaded(items, "item", agents, "agent", "load")
    assert rows_of(got) == want
    if loads and n:
        total = Counter(a for _, a in want)
        end = [(x or 0) + total[i] for i, x in enumerate(loads)]
        r = assignment.balance(got, agents, "agent", "load", 15, 3).first()
        assert (r["agents"], r["least"], r["most"], r["passed"]) == (len(loads), min(end), max(end), np.std(end) <= 15 and max(end) - min(end) <= 3)


def test_match_in_rounds(spark):
    rng = random.Random(3)
    clients = [(i, rng.choice(["f", "m", None]), rng.choice([20, 30, 40, 50])) for i in range(120)]
    hosts = [(i, rng.choice(["f", "f", "f", "m", None]), rng.choice([20, 30]), rng.choice([0, 1, 5, 9])) for i in range(25)]
    rounds = [("sex", "age"), ("sex",), ()]
    got = assignment.match_in_rounds(spark.createDataFrame(clients, "c long, sex string, age int"), "c", spark.createDataFrame(hosts, "h long, sex string, age int, room int"), "h", "room", rounds)
    left, slots, want = list(clients), [(h, s, a) for h, s, a, room in hosts for _ in range(room)], []
    for i, group in enumerate(rounds, 1):
        key = lambda r: tuple(r[{"sex": 1, "age": 2}[g]] for g in group)  # noqa: B023, E731
        free = defaultdict(list)
        for slot in slots:
            free[key(slot)].append(slot)
        for r in list(left):
            if free[key(r)]:
                slot = free[key(r)].pop(0)
                slots.remove(slot)
                left.remove(r)
                want.append((r[0], slot[0], i))
    assert rows_of(got) == sorted(want)
    assert len(want) == min(len(clients), sum(h[3] for h in hosts)) and {r for _, _, r in want} == {1, 2, 3}


# State


def test_keyed_tables_with_null_keys(spark):
    """A null key is one key from batch to batch, and long keys beside it stay exact."""
    big = (1 << 60) + 1
    rows = [(k, 10 * i + j, float(i)) for j, k in enumerate((None, big, big + 1)) for i in range(7)]
    df = spark.createDataFrame(rows, "session long, id long, at double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        fired = rows_of(conversations.throttle(df, 3600.0).filter("fired").select("session", "id"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert fired == [(big, 1), (big + 1, 2), (None, 0)]


def test_cooldown_with_triggers(spark):
    rows = [(1, 0, 0.0, 0, 0.1, 1, None), (1, 1, 1.0, 2, None, 1, False), (1, 2, 5.0, 9, 0.9, 9, True), (1, 3, 20.0, None, 0.69, 3, None), (1, 4, 21.0, 0, 0.7, 0, None), (1, 5, 40.0, 0, 0.0, 4, None), (1, 6, 60.0, None, None, None, True)]
    df = spark.createDataFrame(rows, "session long, id long, at double, hits int, confidence double, turn int, wanted boolean").withColumn("may", conversations.triggered())
    assert [r["id"] for r in conversations.throttle(df, 12.0).filter("fired").orderBy("id").collect()] == [1, 4, 5, 6]


def test_retroactive_stream(spark, tmp_path):
    rng = random.Random(4)
    day = datetime.date(2024, 1, 1)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice("ab"), day + datetime.timedelta(days=rng.randint(0, 40))) for i in range(300)]
    schema = "id long, customer long, category string, day date"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "table")
    sink = retro.retro_sink(path, schema, "customer", retro.reopened, "id", parts=8)
    folder = str(tmp_path / "in")
    for k in range(4):  # in no order of days
        df.filter(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    stream = conversations.read_stream(spark, folder, df.schema)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(120)
    got = retro.current(spark, path, f"{schema}, resolved boolean")
    want = [(i, c, g, d, not any(c == c2 and g == g2 and 0 < (d2 - d).days <= 7 for _, c2, g2, d2 in rows)) for i, c, g, d in rows]
    assert rows_of(got) == sorted(want, key=lambda r: tuple((v is None, v) for v in r))
    assert {r["customer"]: r["resolved_first"] for r in retro.counters(got).collect()} == {c: sum(r[4] for r in want if r[1] == c) for c in {r[1] for r in want}}

    before = retro.versions(spark, path)
    one = spark.createDataFrame([(1000, 3, "a", day), (5, 3, "b", day)], schema)  # a new row, and one in place of row 5
    for _ in range(2):  # run again, the batch gives the same
        sink(one, 9)
        after = retro.versions(spark, path)
        changed = {p for p in after if after[p] != before.get(p)}
        assert len(changed) == 1 and after[changed.pop()] == 9  # the other parts are as they were
        again = retro.current(spark, path, f"{schema}, resolved boolean")
        assert again.filter("id = 1000").count() == 1 and again.filter("customer = 3 AND id = 5").count() == 1


def operations():
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(90):
        at += rng.choice([0, 1, 20, 70])
        op = rng.choice(["put", "get", "get", "delete"])
        rows.append((f"k{i % 4}", i, start + datetime.timedelta(seconds=at), op, f"v{i}" if op == "put" else None))
    return rows


def in_files(df, folder, n=4):
    parts = [df.filter((F.col("id") >= 30 * k) & (F.col("id") < 30 * (k + 1))) for k in range(n)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_store_with_expiry(spark, tmp_path):
    rows = operations()
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp, op string, value string")
    held, want = {}, []
    for k, i, ts, op, v in rows:
        value, end = held.get(k, (None, None))
        if end is not None and ts >= end:
            value, end = None, None
        value, end = (v, ts + datetime.timedelta(seconds=60)) if op == "put" else (None, None) if op == "delete" else (value, end)
        held[k] = (value, end)
        want.append((k, i, op, value))
    assert rows_of(stores.store_table(df, 60.0)) == sorted(want)
    stores.use_state_store(spark)
    try:
        last = spark.createDataFrame([("z", 119, rows[-1][2] + datetime.timedelta(days=1), "get", None)], df.schema)  # lets the watermark pass
        stream = conversations.read_stream(spark, in_files(df.unionByName(last), str(tmp_path / "ops")), df.schema)
        q = stores.store_stream(stream, 60.0).writeStream.outputMode("append").format("memory").queryName("stored").trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = [tuple(r) for r in spark.table("stored").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r for r in got if r[2] != "expired" and r[0] != "z") == sorted(want)
    assert {r[0] for r in got if r[2] == "expired"} >= {k for k, (v, _) in held.items() if v is not None}


def asked_rows():
    rng = random.Random(12)
    start = datetime.datetime(2024, 1, 1)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows, at = [], 0.0
    for i in range(90):
        at += rng.choice([1, 5, 60])
        v = [x + rng.gauss(0, 0.25) for x in rng.choice(base)]
        rows.append((f"c{i % 2}", i, start + datetime.timedelta(seconds=at), rng.choice([f"Question {rng.randint(0, 9)} ", f"q{i}", ""]), v if i % 17 else [0.0] * 5, f"a{i}"))
    return rows


def step_by_step(rows, ttl, most, least):
    caches, out = defaultdict(dict), []
    for name, i, ts, asked, v, answer in rows:
        now, entries, v = ts.timestamp(), caches[name], np.array(v)
        for k in [k for k, e in entries.items() if now - e[0] > ttl]:
            del entries[k]
        for k in sorted(entries, key=lambda k: entries[k][0])[: max(0, len(entries) - most)]:
            del entries[k]
        key = asked.strip().lower()
        if key in entries:
            out.append((name, i, "exact", entries[key][2], 1.0))
            continue
        near = [(float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)) if v.any() and w.any() else 0.0, a) for _, w, a in entries.values()]
        best = max((n for n in near if n[0] >= least), default=None, key=lambda n: n[0])
        if best:
            out.append((name, i, "similar", best[1], round(best[0], 9)))
        else:
            entries[key] = (now, v, answer)
            out.append((name, i, "miss", answer, 0.0))
    return out


def test_semantic_cache(spark, tmp_path):
    rows = asked_rows()
    df = spark.createDataFrame(rows, "cache string, id long, ts timestamp, text string, vector array<double>, answer string")
    for ttl, most in ((300.0, 200), (120.0, 3)):
        want = step_by_step(rows, ttl, most, 0.85)
        assert {r[2] for r in want} == {"exact", "similar", "miss"}
        assert rows_of(stores.cache_table(df, ttl, most).withColumn("score", F.round("score", 9))) == sorted(want)
    stores.use_state_store(spark)
    try:
        stream = conversations.read_stream(spark, in_files(df, str(tmp_path / "asked")), df.schema)
        q = stores.cache_stream(stream, 120.0, 3).writeStream.outputMode("append").format("memory").queryName("cached").trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = rows_of(spark.table("cached").withColumn("score", F.round("score", 9)))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == sorted(want)


def test_table_functions(spark):
    day = datetime.date(2024, 1, 31)
    rows = [(i, 1, "a", day - datetime.timedelta(days=k)) for i, k in enumerate((0, 7, 8, 30, 31, 90, 91, 200))] + [(50, 2, "b", day - datetime.timedelta(days=190))] + [(60 + i, 3, "c", day) for i in range(12)]
    s = sql_functions.register(spark.createDataFrame(rows, "id long, customer long, category string, day date"))
    got = [tuple(r) for r in s.sql("SELECT days_ago, level, score FROM contact_relevance(1) ORDER BY days_ago").collect()]
    assert got == [(0, "high", 100), (7, "high", 65), (8, "medium", 63), (30, "medium", 19), (31, "low", 20), (90, "low", 10), (91, "none", 0), (200, "none", 0)]
    assert s.sql("SELECT * FROM contact_relevance(3)").count() == 10
    assert [tuple(r) for r in s.sql("SELECT days_ago, relevance, recent FROM profile_relevance(2)").collect()] == [(190, "outdated", 0)]
    assert [r["days_ago"] for r in s.sql("SELECT * FROM similar_contacts(1, 'a') ORDER BY place").collect()] == [0, 7, 8, 30]  # 30 days by default
    assert s.sql("SELECT * FROM similar_contacts(1, 'a', 100)").filter("came_back").count() == 4


def test_candidate_cascade(spark):
    names = spark.createDataFrame([("푸른하늘",), ("Gold Card",), ("gold",), ("",), (None,), ("silver card plus",)], "name string")
    asked = spark.createDataFrame([(1, "gold card"), (2, "부른 하늘"), (3, "card with silver, plus"), (4, "card plus silver"), (5, None), (6, " "), (1, "gold")], "query long, text string")
    got = {(r["query"], r["rank"]): (r["name"], r["step"], round(r["score"], 4)) for r in fuzzy.candidate_cascade(asked.filter("NOT (query = 1 AND text = 'gold')"), names).collect()}
    assert got[1, 1] == ("Gold Card", "exact", 1.0) and got[1, 2] == ("gold", "contains", 0.89)
    assert got[2, 1] == ("푸른하늘", "sound", 0.9)
    assert got[4, 1] == ("silver card plus", "words", 0.75)
    assert not {k for k in got if k[0] in (5, 6)}
    with pytest.raises(ValueError, match="10000"):
        fuzzy.candidate_cascade(asked, spark.range(10_001).selectExpr("cast(id as string) as name"))


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_line_packing(spark):
    """Lines wrapped at 80 characters and packed to 280 behind a heading, one by one."""
    items = spark.read.parquet(str(SMALL / "benchmark.parquet")).collect()
    want = []
    for r in items:
        parts = [m for line in (r["text"] or "").split("\n") for m in re.findall(r"[^\n\r\u0085\u2028\u2029]{1,80}", line)]
        chunks, held = [], None
        for part in parts:
            if held is not None and len(held) + 1 + len(part) > 280:
                chunks.append(held)
                held = part
            else:
                held = part if held is None else f"{held}\n{part}"
        want += [(r["item_id"], k, f"# item {r['item_id']}\n{x}") for k, x in enumerate([*chunks, held] if held is not None else [])]
    got = plans.QUERIES["n29_line_packing"](spark, str(SMALL))
    assert rows_of(got) == sorted(want)


def test_fragments(spark):
    texts = [("x" * n, str(n)) for n in (1, 9, 10, 500, 3000)] + [("é" * 77, "e")]
    got = spark.createDataFrame(texts, "t string, k string").select("t", text.fragments(F.col("t"), F.col("k")).alias("f")).collect()
    sizes = []
    for r in got:
        assert "".join(f["text"] for f in r["f"]) == r["t"] and [f["fragment"] for f in r["f"]] == list(range(len(r["f"])))
        assert all(10 <= len(f["text"]) <= 60 for f in r["f"][:-1])
        sizes += [len(f["text"]) for f in r["f"][:-1]]
    assert 30 < np.mean(sizes) < 40 and np.std(sizes) > 5


def test_lookup_of_alike_documents(spark, monkeypatch):
    """Many documents of few kinds and many queries of few sets: one of each meets, and all queries get their best."""
    entries = [(t, n, float(r)) for n in range(200) for t, r in (("red", 1), ("ring", n % 2), (f"kind{n % 3}", 0.5))]
    asked = [(q, t) for q in range(90) for t in (("redring",) if q % 3 else ("red", f"kind{q % 2}"))] + [(90, None), (90, "ring")]
    index, terms = spark.createDataFrame(entries, "term string, doc long, relevance double"), spark.createDataFrame(asked, "query long, term string")
    sizes, plain = [], retrieval.lookup
    monkeypatch.setattr(retrieval, "lookup", lambda i, t: sizes.append((i.select("doc").distinct().count(), t.select("query").distinct().count())) or plain(i, t))
    got = rows_of(retrieval.lookup_or_split(index, terms, 4).select("query", "doc", "score", "rank"))
    assert sizes == [(6, 4)]
    parts = spark.createDataFrame([(q, p) for q, t in asked for p in (("red", "ring") if t == "redring" else (t,))], "query long, term string")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    assert got == rows_of(plain(index, parts).withColumn("rank", F.row_number().over(w)).filter("rank <= 4"))


def test_trigram_search_of_alike_documents(spark, monkeypatch):
    """Queries of few sets against documents of few kinds, one with two rows; few pairs are scored, and all queries get their best."""
    rng = random.Random(8)
    names = ["small ring", "small rings", "red bolt", "old plate", "ring"]
    docs = [(n, rng.choice(names), rng.choice(["red", "ring", None])) for n in range(150)] + [(3, "small ringlet", "old")]
    queries = [(q, rng.choice([["small", "rings", "of", "red", "plate"], ["plate"], ["ring", "ring"], ["of"], ["absent"]])) for q in range(40)]
    d, q = spark.createDataFrame(docs, "doc long, name string, kind string"), spark.createDataFrame(queries, "query long, terms array<string>")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    texts = {}
    for n, *row in docs:
        texts.setdefault(n, set()).update(t for t in row if t)
    want = []
    for i, terms in queries:
        found = []
        for n, own in texts.items():
            s = [max(len(grams(t) & grams(x)) / len(grams(t) | grams(x)) for x in own) for t in {t for t in [t for t in terms if len(t) >= 3][:3]}]
            found += [(-round(sum(s), 9), n)] if s and max(s) >= 0.3 else []
        want += [(i, n, round(-s, 6), r) for r, (s, n) in enumerate(sorted(found)[:5], 1)]
    kinds, plain = [], retrieval.first_of_alike
    monkeypatch.setattr(retrieval, "first_of_alike", lambda *a: kinds.append(plain(*a).filter("place = 1").count()) or plain(*a))
    assert rows_of(retrieval.trigram_search(d, ["name", "kind"], q, 5).select("query", "doc", F.round("score", 6), "rank")) == sorted(want)
    assert kinds == [len({frozenset(t) for t in texts.values()})] and kinds[0] <= 16


def test_sources_of_a_budget_are_bounded(spark, monkeypatch):
    """What a query's call may give meets it, not every part of its type or brand."""
    most, plain = [], retrieval.within_budget
    monkeypatch.setattr(retrieval, "within_budget", lambda q, sources, *a: most.extend(df.groupBy("query").count().agg(F.max("count")).first()[0] for df in sources.values()) or plain(q, sources, *a))
    assert plans.QUERIES["v12_call_budget"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(most) == 3 and max(most) <= retrieval.call_rows(5) == 10
