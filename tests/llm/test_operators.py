"""Each operator against a brute-force version on a small fixture with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, quality, sentencepiece_codec, suffix_dedup, suffix_sort, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, tid string, id string, n string, line string"


def corpus(seed: int = 3) -> list[tuple]:
    """doc_id, text, lang: copies, near copies, repeated rows and lines, a null id, null and empty texts, a very long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.randint(5, 200)) for _ in range(30)]
    shared = make(60)
    texts = list(base)
    texts += base[:5] + [base[0]] * 4
    for t in base[5:12]:
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [f"{make(20)} {shared} {make(30)}" for _ in range(6)]
    texts += ["\n".join([make(8), "a line that many share, in full", make(9)]) for _ in range(5)]
    texts += ["a line that many share, in fall\nshort", "a line that many share, in fulll", "x" * 50, "x" * 51, "", " \n\t", None, None, make(8000), shared + "\n" + shared]
    rows = [(i, t, rng.choice(["en", "fr", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (7, "another text under an id that exists", "en"), (None, base[8], None), (None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "r", "t", "i", "n", "l") for i, t, g in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def key(x):
    return tuple((v is None, v) for v in x)


def same(df, want) -> None:
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_exact_dedup(docs, rows, empty, monkeypatch):
    from pyspark.sql import functions as F

    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t or "")) for i, t, _ in rows]
    for snapshot in (F.col("doc_id") % 2, F.pmod(F.xxhash64("doc_id", F.rand(1)), F.lit(4)), F.lit(None), F.lit(3)):
        for most in (0, exact_dedup.SEND_ROWS):
            monkeypatch.setattr(exact_dedup, "SEND_ROWS", most)
            same(exact_dedup.deduplicate(docs, snapshot, bucket_keys=7), want)
    assert exact_dedup.deduplicate(empty, F.lit(1)).count() == 0


def test_binary_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 1000, 30_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        made = exact_dedup.fuse_build(keys)
        assert exact_dedup.fuse_probe(keys, *made).all()
        others = rng.integers(0, 2**63, 20_000).astype(np.uint64) | np.uint64(2**63)
        assert exact_dedup.fuse_probe(others, *made).mean() < 0.01


def shingles(text: str | None, n: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_near_dedup(docs, rows, empty, words, percent):
    sets = [shingles(t, words) for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    least = {x: min((r[0] for r, y in zip(rows, label, strict=True) if y == x and r[0] is not None), default=None) for x in label}
    want = [(r[0], len(s), least[x] if s else r[0], r[0] == (least[x] if s else r[0])) for r, s, x in zip(rows, sets, label, strict=True)]
    same(near_dedup.near_duplicates(docs, words, percent), want)
    assert near_dedup.near_duplicates(empty, words, percent).count() == 0


def test_near_dedup_blocks(spark, monkeypatch):
    """A group that takes many blocks, with links that only pairs of its blocks show."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(10)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 1) for _, t in rows]
    label = list(range(120))
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 93 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    least = {x: min(i for i in range(120) if label[i] == x) for x in label}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 93).collect()}
    assert got == {i: least[label[i]] for i in range(120)} and len(set(got.values())) > 3


def test_near_dedup_finds_pairs_at_the_bound(spark):
    """400 pairs of a similarity of exactly 85 of 100: recall 1. A pair just under it is none."""
    rng, rows = random.Random(8), []
    for i in range(400):
        w = [f"{i}x{rng.random()}" for _ in range(40)]
        rows += [(2 * i, " ".join(w[:37])), (2 * i + 1, " ".join(w[:34] + w[37:]))]
    rows += [(900, " ".join(f"y{k}" for k in range(37))), (901, " ".join(f"y{k}" for k in range(4, 41)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()}
    assert got == {i: i if i >= 900 else i - i % 2 for i, _ in rows}


def test_near_dedup_of_a_group_around_its_hub(spark, monkeypatch):
    """Many blocks, no member of which has to meet another block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 80], f"x{i}", *base[i % 80 + 1 :]])) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert {r["component_id"] for r in got} == {0}


def edit_within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    n = max(len(a), len(b))
    return any(a[:j] == b[:j] and a[j + (len(a) >= len(b)) :] == b[j + (len(b) >= len(a)) :] for j in range(n))


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup(spark, docs, rows, empty, edits):
    distinct = {(i, t or "") for i, t, _ in rows}
    tids = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in distinct], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    first: dict[str, tuple] = {}
    for i, t in distinct:
        for k, line in enumerate(t.split("\n")):
            place = (i is None, i or 0, k, tids[t])
            if line.strip(" \t\n\v\f\r"):
                first[line] = min(first.get(line, place), place)
    near = {a for a in first for b in first if edits and a != b and len(a) >= 20 and len(b) >= 20 and first[b] < first[a] and edit_within_one(a, b)}
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [x in first and (x in near or first[x] != (i is None, i or 0, k, tids[t or ""])) for k, x in enumerate(lines)]
        want.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else t, len(lines), sum(gone)))
    got = line_dedup.deduplicate_lines(docs, max_edits=edits)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    same(got.select("doc_id", "text", "n_lines", "n_dropped"), want)
    assert not edits or near
    assert line_dedup.deduplicate_lines(empty, edits).count() == 0


def test_pipeline_takes_short_repeated_lines_out(spark):
    import corpus_pipeline

    texts = ["Read more\na line of its own, long enough\n\n}", "日本語の文です。\nRead more\n\nRead mere\n  ", "日本語の文です。\n}\n\n  \nend", "Read more"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(0, texts[0], len(texts[0])), (1, "日本語の文です。\n\nRead mere\n  ", 22), (2, "\n  \nend", 7)]
    same(corpus_pipeline.line_stage(spark, docs, "").select("doc_id", "text", "n_chars"), want)


def test_deletion_hashes():
    own, without = line_dedup.neighbourhood("aébc")
    assert [int(line_dedup.neighbourhood(x)[0]) for x in ("ébc", "abc", "aéc", "aéb")] == without.tolist() and own not in without


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    long = [words_of(t) for _, t, _ in rows if len(words_of(t)) > 40]
    items = [(k, " ".join(w[a : a + n])) for k, (w, a, n) in enumerate((rng.choice(long), rng.randint(0, 20), rng.choice([1, 3, 4, 5, 7, 12, 13, 14, 20])) for _ in range(60))]
    items += [(100, "nothing of this text is anywhere, at all, we hope, in any of the documents"), (101, ""), (102, None), (None, items[0][1]), items[5]]
    windows = defaultdict(set)
    for k, t in items:
        w = words_of(t)
        for a in range(max(0, len(w) - min(13, len(w)) + 1) if w and k is not None else 0):
            windows[tuple(w[a : a + min(13, len(w))])].add(k)
    want = []
    for i, t, _ in rows:
        w, hit, found = words_of(t), set(), set()
        for n in {len(g) for g in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        want.append((i, t, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.contamination(docs, bench), [(i, *rest) for i, _, *rest in want])
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_decontamination_by_items_without_an_id(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, passage), (2, "a text of its own")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (5, "other")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (14, 0, True), 2: (0, 0, False)}


def test_pipeline_decides_on_each_text(spark, tmp_path):
    """Null ids, ids that are there twice with different texts, rows that are there twice, ids that no double holds."""
    import corpus_pipeline

    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e, f, g, bad = (make(60) for _ in range(8))
    big = 2**60
    df = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    near = df([(1, a), (None, a + " x"), (2, a), (2, b), (None, c), (None, c + " x"), (None, d), (None, d), (3, e), (3, e + " x"), (4, f), (4, f), (big, g), (big + 1, g), (big + 2, make(60)), (None, ""), (None, ""), (8, ""), (9, " ")])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, near, "").collect()]
    assert sorted(i for i, t in got if t and i is not None and t != " ") == [1, 2, 3, 4, big, big + 2]
    assert (2, b) in got and (1, a) in got and (big, g) in got
    assert sorted(t in (c, c + " x") for i, t in got if i is None and t) == [False, True] and (None, d) in got
    assert sorted(i is None for i, t in got if not t.strip()) == [False, False, True, True]

    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df([(None, bad), (None, a), (5, bad), (5, b), (big + 1, c), (big, bad)])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (5, b), (big + 1, c)], key=repr)


def repeats(texts: list[bytes], n: int) -> list[tuple[int, int, int, str]]:
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(kept)))
    return out


@pytest.mark.parametrize(("memory", "shard_bytes"), [(suffix_dedup.MEMORY, suffix_dedup.SHARD_BYTES), (1000, suffix_dedup.SHARD_BYTES), (1000, 2000)])
def test_suffix_dedup(docs, rows, empty, memory, shard_bytes):
    want = [(i, *r) for (i, _, _), r in zip(rows, repeats([(t or "").encode() for _, t, _ in rows], 200), strict=True)]
    got = suffix_dedup.remove_repeats(docs, memory=memory, shard_bytes=shard_bytes, with_text=False)
    same(got, want)
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_sort(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        cap, kinds = rng.choice([3, 5, 9, 20]), rng.choice([1, 2, 3, 20])
        monkeypatch.setattr(suffix_sort, "CAP", cap)
        pieces: list[bytes] = []
        for _ in range(rng.randint(1, 8)):
            piece = bytes(rng.randint(1, kinds) for _ in range(rng.randint(1, 60)))
            pieces.append(pieces[-1][: rng.randint(1, 60)] + piece if pieces and rng.random() < 0.5 else piece)
        text = b"\0".join(pieces) + b"\0"
        count = Counter(text[i : i + cap] for i in range(len(text) - cap + 1))
        found = suffix_sort.repeated(np.frombuffer(text, np.uint8), memory=rng.choice([10, 200, 1 << 20]))
        for i in range(len(text) - cap + 1):
            if 0 not in text[i : i + cap]:
                assert found[i] == (count[text[i : i + cap]] > 1)


def test_url_filter(spark):
    pages = [
        (1, "http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        (2, "https://m.example.net/de/1?x#y", "m.example.net", "/de/1", "net/", "block"),
        (3, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (4, "https://a.example.com/de/spam", "a.example.com", "/de/spam", "example.com/de/", "block"),
        (5, "https://casino.example.org/fr/1", "casino.example.org", "/fr/1", "org/fr/", "allow"),
        (6, "https://casino.example.org/en", "casino.example.org", "/en", None, "block"),
        (7, "https://casinos.example.org/en", "casinos.example.org", "/en", None, "allow"),
        (8, "http://free-bets.example.com", "free-bets.example.com", "", None, "block"),
        (9, "http://free-free.example.com/", "free-free.example.com", "/", None, "allow"),
        (10, "http://x.net", "x.net", "", None, "allow"),
        (11, "x.net/a", "", "", None, "allow"),
        (12, "", "", "", None, "allow"),
        (13, None, "", "", None, "allow"),
        (13, None, "", "", None, "allow"),
        (None, "://org/fr/://b", "org", "/fr/://b", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(*p[:2], "h", "v") for p in pages], "page_id long, url string, host string, verdict string")
    same(url_filter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict"), [(p[0], *p[2:]) for p in pages])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_filter_reads_the_whole_url(spark):
    pages = [
        (1, "https://example.org/en/go?to=Casino-xxx", "block", 2, 0),
        (2, "http://x.org/#porn", "block", 1, 0),
        (3, "casino-porn.com/xxx", "block", 3, 0),
        (4, "http://x.org/free?get=bonus", "block", 0, 2),
        (5, "http://x.org/free?get=free", "allow", 0, 1),
        (6, "https://example.net/en/1?casino", "allow", 1, 0),  # a rule decides
        (7, None, "allow", 0, 0),
    ]
    got = url_filter.filter_urls(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string"))
    same(got.select("page_id", "verdict", "strict_hits", "soft_hits"), [(p[0], *p[2:]) for p in pages])


def test_language_id(spark, empty):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    syllables = {"a": ["ba", "lo", "mi", "ter"], "b": ["sch", "ung", "ei", "ich"], "c": ["eau", "que", "oi", "ment"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(30))
    rows = [(i, make(lang), lang) for i in range(120) for lang in [rng.choice("abc")]] + [(200, None, "a"), (201, "123 -- !", "b"), (202, "", "c"), (203, make("c") * 500, None), (5, make("a"), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.col("doc_id") % 3 == 0
    model = language_id.fit(docs, ~held, "doc_id", "text", "lang")
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model).collect()}
    assert {(i, "und" if not t or not re.search("[a-z]", t) else lang or "c") for i, t, lang in rows} == got
    none = language_id.fit(empty, F.lit(True), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_bit_sliced_filter_has_every_language_of_a_gram():
    import pandas as pd

    rng = random.Random(4)
    langs = tuple(f"l{k:02}" for k in range(11))
    texts = {lang: ["".join(rng.choice("abcdefgh éß") for _ in range(300)) for _ in range(3)] for lang in langs}
    rows = pd.DataFrame([(lang, t) for lang in langs for t in texts[lang]], columns=["lang", "text"])
    words = pd.concat(language_id.slot_bits(langs)(iter([rows[:10], rows[10:]])))
    words = words.groupby(["byte", "octet"])["bits"].agg(lambda x: np.bitwise_or.reduce(x.to_numpy())).reset_index()
    model = language_id.build(langs, words)
    seen = {lang: {g for t in texts[lang] for part in language_id.grams(t) for g in part.tolist()} for lang in langs}
    for k, lang in enumerate(langs):
        at = language_id.places(np.array(sorted(seen[lang]), dtype=np.uint32))
        assert ((model[1][at[0]] & model[1][at[1]] & model[1][at[2]])[:, k // 8] >> k % 8 & 1).all()
    for _ in range(30):  # the corrected popcounts against plain sets
        text = "".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(1, 400)))
        g = [x for part in language_id.grams(text) for x in part.tolist()]
        plain = np.array([sum(x in seen[lang] for x in g) / len(g) for lang in langs])
        assert np.abs(language_id.shares(model, text) - plain).max() < 0.02


def test_pieces_of_a_long_text_have_the_same_grams(monkeypatch):
    text = "Ein längerer Text, with some words 12 and ½ of others. " * 9
    whole = np.concatenate(list(language_id.grams(text)))
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (np.concatenate(list(language_id.grams(text))) == whole).all()


def test_language_id_knows_letters_by_their_category(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some words of a language", "en"), (2, "½", None), (3, "² 3", None), (4, "ʰ", None), (5, "字", None), (6, "Ⅷ ①", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), "doc_id", "text", "lang")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {1: "en", 2: "und", 3: "und", 4: "en", 5: "en", 6: "und"}


def test_quality(spark, empty):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper(), "x"))
        labels.append((i, int(good) if rng.random() < 0.95 else None))
    rows += [(500, None, "x"), (501, "", "x"), (502, "abc " * 40_000, "x"), (3, "repeated id", "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = F.col("doc_id") % 4 == 0
    weights = quality.fit(docs, known, ~held)
    scored = quality.score(docs, weights).filter(held).join(known, "doc_id").filter("quality IS NOT NULL").collect()
    assert sum((r["score"] >= quality.CUTOFF) == bool(r["quality"]) for r in scored) >= 0.95 * len(scored)
    edge = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).filter("doc_id >= 500").collect()}
    assert edge[500] == edge[501] and all(0 <= s <= 1 for s in edge.values())
    again = quality.fit(docs, known, ~held)
    assert all((again[k] == weights[k]).all() for k in weights)
    assert quality.score(empty, quality.fit(empty, known, F.lit(True))).count() == 0


def test_quality_against_a_plain_convolution():
    """Chunk by chunk, window by window and filter by filter; an existing score column gives way."""
    rng = np.random.default_rng(5)
    w = {k: rng.normal(0, 0.4, shape).astype(np.float32) for k, shape in quality.SHAPES.items()}
    for n in (0, 1, 255, 256, 257, 449, 2000):
        text = "".join(rng.choice(list("abc é\n"), n))
        data = text.encode()
        tops = []
        for begin in range(0, max(1, len(data) - quality.CHUNK + quality.HOP), quality.HOP):
            chunk = data[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            tops.append([max(sum(float(w["embed"][chunk[s + i], d]) * float(w["filters"][i * quality.DIM + d, f]) for i in range(quality.WIDTH) for d in range(quality.DIM)) for s in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)) + float(w["bias"][f]) for f in range(quality.FILTERS)])
            if begin + quality.CHUNK >= len(data):
                break
        h = np.tanh(np.array(tops))
        logit = np.concatenate([h.mean(0), h.max(0)]) @ w["out"] + w["offset"][0]
        assert quality.scores(w, [text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_columns_that_operators_add_replace_those_of_the_table(spark):
    names = ["doc_id", "text", "gone", "n_lines", "n_dropped", "ids", "decoded", "score", "row", "tid", "id", "a.b"]
    docs = spark.createDataFrame([(1, "one line here\nand another", *"x" * 10), (2, "one line here", *"y" * 10)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    lines = line_dedup.deduplicate_lines(docs)
    assert lines.columns == [c for c in names if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {(r["doc_id"], r["text"], r["gone"], r["a.b"], r["n_lines"], r["n_dropped"]) for r in lines.collect()} == {(1, "one line here\nand another", "x", "x", 2, 0), (2, "", "y", "y", 1, 1)}
    coded = sentencepiece_codec.encode(docs)
    assert coded.columns == [c for c in names if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert {r["decoded"] for r in coded.collect()} == {"one line here\nand another", "one line here"}
    scored = quality.score(docs, {k: np.ones(shape, np.float32) for k, shape in quality.SHAPES.items()})
    assert scored.columns == names and scored.schema["score"].dataType.typeName() == "double" and scored.count() == 2
    files = license_scan.scan_licenses(docs.withColumnsRenamed({"gone": "dir", "n_lines": "best", "score": "path"}), keep=("doc_id", "dir", "best", "tid", "a.b"))
    assert files.columns == ["doc_id", "dir", "best", "tid", "a.b", "path", "own_license", "own_score", "license", "inherited_from"] and files.count() == 2


def test_workers_need_not_find_this_folder(tmp_path):
    """From another folder, with the repository only on the driver's path."""
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op1_quality_classifier", "op2_sentencepiece", "op3_url_filter", "op5_language_id", "op9_decontaminate"):
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all ran")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_a_model_that_normalises_is_refused(tmp_path):
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(Path(sentencepiece_codec.MODEL_PATH).read_bytes())
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sentencepiece_codec.Model.load(model.SerializeToString())


def test_a_long_text_is_encoded_in_parts(monkeypatch):
    from pathlib import Path

    model = sentencepiece_codec.Model.load(Path(sentencepiece_codec.MODEL_PATH).read_bytes())
    text = "Words, and  more words;\n日本語 here. " * 40
    whole = model.encode([text])[0].tolist()
    for name, value in (("BATCH_CHARS", 50), ("AT_ONCE", 7), ("MEMO_WORDS", 5), ("CELLS", 20)):
        monkeypatch.setattr(sentencepiece_codec, name, value)
    assert model.encode([text], {})[0].tolist() == whole


def test_sentencepiece(spark, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    texts = [t for _, t, _ in rows] + ["  two  blanks ", "aaaa aaaaaaaaa", "日本語 🤖 x\ny\t\tz", "....!!!---=== 1234567 000", "The THE theThe", "\u0000\u0001"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, coded string")
    out = {r["doc_id"]: r for r in sentencepiece_codec.encode(df).collect()}
    for i, t in enumerate(texts):
        assert (out[i]["ids"], out[i]["decoded"]) == ((None, None) if t is None else (library.encode(t), t))
    assert sentencepiece_codec.encode(df.limit(0)).count() == 0


def test_sentencepiece_unigram_is_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    scores = np.array([0.0, -3.1, -2.3, -2.9, -3.7, -3.3, -3.97, -4.03, -5.01])
    model = sentencepiece_codec.Model(pieces, scores, np.array([2] + [1] * 8), sentencepiece_codec.UNIGRAM, True)
    rng = random.Random(3)

    def best(word: str) -> tuple[float, list[int]]:
        if not word:
            return 0.0, []
        found = [(scores[k] + best(word[len(p) :])[0], [k, *best(word[len(p) :])[1]]) for k, p in enumerate(pieces) if k and word.startswith(p)]
        return max(found)

    for _ in range(60):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        assert model.encode([word])[0].tolist() == best("▁" + word)[1]


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", notice, "Apache-2.0", "Apache-2.0", None),
        ("a/b/COPYING.txt", "Some words here. Released under the MIT License.\nmore", "MIT", "MIT", None),
        ("a/b/c/x.py", "print(1)", None, "MIT", "a/b"),
        ("a/d/x.py", "nothing", None, "Apache-2.0", "a"),
        ("a/d/y.py", "x\nLicensed under CC BY-NC 4.0.\n" + "word " * 30_000, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        ("ab/x.py", "", None, None, None),
        ("ab/x.py", "", None, None, None),
        ("x.py", None, None, None, None),
        (None, notice, "Apache-2.0", "Apache-2.0", None),
        (None, "no", None, None, None),
        ("e/licensed", notice, "Apache-2.0", "Apache-2.0", None),
        ("e/x", "This license version is not a notice of any kind, nor meant as one by anyone.", None, None, None),
    ]
    df = spark.createDataFrame([(*f[:2], "d", "b") for f in files], "path string, text string, dir string, best string")
    same(license_scan.scan_licenses(df).drop("own_score"), [(f[0], *f[2:]) for f in files])
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_scan_of_whole_files_and_long_sentences(spark):
    mit = "MIT License\n\nCopyright (c) 2001 Some One\n\n" + dict(license_scan.FILES)["MIT"].replace(". ", ".\n\n").replace("software and", "software\nand")
    long = "the Apache License, Version 2.0 " + " ".join(f"w{i} of the license" for i in range(25_000))
    files = [("p/LICENSE", mit, "MIT"), ("p/notes.txt", "Nothing but notes.", None), ("q/long.txt", long, None), ("q/LICENSE", "nothing of the kind", None)]
    got = license_scan.scan_licenses(spark.createDataFrame([f[:2] for f in files], "path string, text string"))
    assert {(r["path"], r["own_license"]) for r in got.collect()} == {(f[0], f[2]) for f in files}


def test_license_scan_weighs_ordinary_words_by_their_frequency(spark):
    """Words outside the templates have real document frequencies, so that a notice among ordinary words is found."""
    notice = "You may use it as it was released under the MIT License"
    files = [(f"f{i}", "It may be as it was, you use it so; the rest is here.") for i in range(400)] + [("n", notice)]
    words = [[w for w in re.split("[^a-z0-9]+", t.lower()) if w] for _, t in files]
    df = Counter(w for ws in words for w in set(ws))
    vector = lambda ws: {w: k * (np.log((1 + len(files)) / (1 + df[w])) + 1) for w, k in Counter(ws).items()}
    a, b = vector(words[-1]), vector("released under the mit license".split())
    cosine = sum(x * b.get(w, 0) for w, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = license_scan.scan_licenses(spark.createDataFrame(files, "path string, text string")).filter("own_license IS NOT NULL").collect()
    assert [(r["path"], r["own_license"]) for r in got] == [("n", "MIT")]
    assert got[0]["own_score"] == pytest.approx(cosine, abs=2e-6)
