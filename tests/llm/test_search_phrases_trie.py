"""Exact search, collocations and the prefix trie against brute force: nulls, ties, repeats, empty and long rows, many blocks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations, prefix_trie, topk_search


def key(x):
    return tuple((v is None, v) for v in x)


def same(df, want) -> None:
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def best(rows, k, is_query):
    """rows: (id, {term: weight}); each query's k best of the other rows."""
    out = []
    for i, (q, mine) in enumerate(rows):
        if is_query(q):
            dot = lambda other: max(-(1 << 63), min((1 << 63) - 1, sum(w * other.get(t, 0) for t, w in mine.items())))  # noqa: B023, E731
            others = sorted((-dot(other), d is None, d or 0) for j, (d, other) in enumerate(rows) if j != i)
            out += [(q, r, None if none else d, -s) for r, (s, none, d) in enumerate(others[:k], 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    make = lambda: [round(rng.gauss(0, 0.4), 2) for _ in range(12)]
    rows = [(i, make()) for i in range(230)]
    rows += [rows[50], rows[50], rows[50], rows[7], (50, make()), (None, rows[3][1]), (None, make())]  # repeats, and an id with two vectors
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # one vector very often: ties
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")] * 12), (350, [float("inf")] + [0.0] * 11), (400, []), (401, [0.0] * 12), (402, [0.5] * 3)]
    return rows


@pytest.mark.parametrize(("blocks", "k"), [((1024, 8192), 5), ((3, 7), 5), ((3, 7), 1), ((1024, 8192), 400)])
def test_top_k(spark, vectors, monkeypatch, blocks, k):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk_search, "ROW_BLOCK", blocks[1])
    monkeypatch.setattr(topk_search, "CELLS", 50)
    monkeypatch.setattr(topk_search, "LEAST_ROWS", 60)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], "id long, embedding array<double>, score int, query string, rank int")
    terms, weights = topk_search.sparse(F.col("embedding"))
    rows = df.select("id", terms.alias("terms"), weights.alias("weights"), "score", "query", "rank")
    fit = [(i, dict(enumerate(math.floor(256 * x) for x in v))) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    same(topk_search.top_k(rows.filter("id % 50 = 0"), rows, k), best(fit, k, lambda i: i is not None and i % 50 == 0))


def test_top_k_of_sparse_rows(spark):
    """Terms of any number, repeated terms, weights whose products pass 64 bits, a dotted id column, other queries than rows."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([3, -8, 1 << 40, 77, 5]) for _ in range(n)], [rng.randint(-9, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5] * 9)]
    rows += [(60, [3, 5], [(1 << 62) - 1, 1 << 61]), (61, [3, 5], [-(1 << 63), 4]), (62, [3], [5, 6]), (63, None, [1]), (64, [1, None], [1, 1])]
    df = spark.createDataFrame(rows, "`an.id` long, terms array<long>, weights array<long>")
    fit = []
    for i, t, w in rows:
        if t is not None and None not in t and len(t) == len(w):
            total = Counter()
            for a, b in zip(t, w, strict=True):
                total[a] += b
            fit.append((i, total))
    same(topk_search.top_k(df, df, 4, id_col="an.id"), best(fit, 4, lambda i: True))
    alone = df.filter("`an.id` = 17").select(F.lit(9999).cast("long").alias("an.id"), "terms", "weights")
    own = best([*fit, (9999, dict(fit)[17])], 4, lambda i: i == 9999)
    same(topk_search.top_k(alone, df, 4, id_col="an.id", own=False), own)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "id long, terms array<long>, weights array<long>")
    assert topk_search.top_k(df, df, 5).count() == 0
    one = spark.createDataFrame([(0, [1], [2])], df.schema)
    assert topk_search.top_k(one, one, 5).count() == 0  # no row but its own
    assert topk_search.top_k(df, one, 5).count() == topk_search.top_k(one, df, 5).count() == 0


def fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def expected_phrases(rows, max_n, min_count, absorbed, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        held = Counter()
        for p, a in found.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}:
                held[sub] = max(held[sub], a)
        scored = []
        for p, a in found.items():
            s, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if not (p in held and 100 * held[p] >= absorbed * a):
                scored.append((-s, -a, " ".join(p).encode(), " ".join(p), a, count[p[:k]], count[p[k:]], s))
        out += [(lang, r, p, a, left, right, n[lang], s) for r, (_, _, _, p, a, left, right, s) in enumerate(sorted(scored)[:most], 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["the", "of", "The", "a", "é", "b\x01", "　x", "zug", "zu", "z", "\x00", "ÀB"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "; "]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), make(rng.randint(0, 60))) for _ in range(60)]
    rows += [("en", "one very common pair here")] * 120 + [("en", None), (None, ""), ("xx", " . "), ("yy", "lonely"), ("en", "the of " * 300), ("fr", make(900).replace("\n", " ").replace(".", "").replace(",", ""))]
    return rows


@pytest.mark.parametrize(("max_n", "min_count", "absorbed", "most", "small"), [(3, 10, 50, 2000, True), (3, 10, 50, 2000, False), (2, 2, 100, 7, True), (4, 3, 50, 50, True), (5, 2, 10, 2000, True)])
def test_collocations(spark, texts, monkeypatch, max_n, min_count, absorbed, most, small):
    if small:
        monkeypatch.setattr(collocations, "BATCH_BYTES", 90)
    df = spark.createDataFrame([(g, t, 1, "p", 2) for g, t in texts], "lang string, text string, n int, phrase string, size int").repartition(3)
    got = collocations.collocations(df, max_n, min_count, absorbed, most, range_bytes=60 if small else collocations.RANGE_BYTES)
    same(got, expected_phrases(texts, max_n, min_count, absorbed, most))


def test_collocations_empty(spark):
    df = spark.createDataFrame([], "lang string, `a.text` string")
    assert collocations.collocations(df, text_col="a.text").count() == 0
    one = spark.createDataFrame([(None, None), ("en", "a b")], df.schema)
    assert collocations.collocations(one, text_col="a.text").count() == 0
    same(collocations.collocations(one, min_count=1, text_col="a.text"), [("en", 1, "a b", 1, 1, 1, 2, 1_000_000)])


def test_collocations_exact_products(spark, monkeypatch):
    """Counts of billions: a * a passes 64 bits."""
    big = [("en", "a b", 2, 4_000_000_007), ("en", "a", 1, 9_000_000_001), ("en", "b", 1, 8_000_000_011), ("en", "", 0, 1 << 40)]
    counts = spark.createDataFrame(big, "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    a, left, right = 4_000_000_007, 9_000_000_001, 8_000_000_011
    same(collocations.collocations(counts), [("en", 1, "a b", a, left, right, 1 << 40, 1_000_000 * a * a // (left * right))])


def expected_trie(rows):
    """rows: conv_id, turn, role, text; the contract's rebuilt conversations and their prefixes, node by node."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 9
        paths[c] = ([] if c is None else turns.get(c - int(math.fmod(c, 5)), []))[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    least = lambda members: min((m for m in members if m is not None), default=None)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(all(len(x) == len(q) or x[: len(q)] != q for x in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if c is not None and len(paths[c]) == len(p))))
        out.append((least(members), len(p), least(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    said = ["hello", "", None, "what?", "é" * 9, "no"]
    rows = [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(said)) for c in range(-7, 40) if c % 11 for t in range(rng.choice([1, 2, 3, 9, 14]))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 180) for t in range(10)]  # copies of whole conversations
    rows += [rows[0], rows[5], (3, None, "user", "before all"), (3, None, None, None), (None, 1, "user", "nobody"), (None, 2, None, None), (901, 5, "user", "x" * 5000)]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark, talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 8)
    df = spark.createDataFrame([(*r, 1, "d") for r in talks], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    same(got, expected_trie(talks))


def test_prefix_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0
    turnless = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9)  # no first conversation, and its own turn goes
    one = spark.createDataFrame([(turnless, 0, "user", "gone")], schema)
    same(prefix_trie.prefix_trie(*prefix_trie.rebuilt(one)).select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "ends_sha256"), [(turnless, 0, 1, 0, 1, hashlib.sha256(str(turnless).encode()).hexdigest())])


def test_a_long_conversation(spark):
    """A conversation of many turns sends a row for each of its prefixes, not for each pair."""
    rows = [(c, t, "user", f"{t}") for c in (5, 10) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = prefix_trie.numbered(df)
    convs = said.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    got = prefix_trie.prefix_trie(convs, said.withColumnRenamed("pos", "depth").withColumn("n_turns", F.lit(3000))).orderBy("depth").select("depth", "n_convs", "n_leaves", "saved_tokens").collect()
    sizes = [len(str(t)) for t in range(3000)]
    assert [tuple(r) for r in got] == [(d, 2, 1, sum(sizes[max(0, d - 1) :])) for d in range(3001)]
