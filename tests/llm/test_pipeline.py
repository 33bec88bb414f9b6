"""The pipeline, whole and stage by stage, against brute force; and ids, ties and names that operators have to bear."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, quality, sentencepiece_codec, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = Path("/root/testdata/sf0.1")


def key(x):
    return tuple((v is None, v) for v in x)


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edit_within_one(a, b):
    n = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 1 and any(a[:j] == b[:j] and a[j + (len(a) >= len(b)) :] == b[j + (len(b) >= len(a)) :] for j in range(n))


def without_lines(rows):
    """rows: (id, text) of distinct ids; the line stage."""
    place = lambda i, k: (i is None, i or 0, k)
    first = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                first[line] = min(first.get(line, place(i, k)), place(i, k))
    near = {a for a in first for b in first if a != b and len(a) >= 20 and len(b) >= 20 and first[b] < first[a] and edit_within_one(a, b)}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for k, x in enumerate(lines) if not (x in first and (x in near or first[x] != place(i, k)))]
        text = t if len(stay) == len(lines) else "\n".join(stay)
        if len(stay) == len(lines) or text.strip(" \t\n\v\f\r"):
            out.append((i, text))
    return out


def one_of_each_group(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    first = {}
    for (i, _), x in zip(rows, label, strict=True):
        first[x] = min(first.get(x, (True, 0)), (i is None, i or 0))
    return [r for r, s, x in zip(rows, sets, label, strict=True) if not s or (r[0] is None, r[0] or 0) == first[x]]


def clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {tuple(w[a : a + min(13, len(w))]) for w in map(words, items) if w for a in range(max(1, len(w) - 12))}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in {len(g) for g in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


@pytest.fixture(scope="module")
def tables():
    """documents, labels and benchmark: junk, copies, near copies, shared lines, passages, nulls, a very long text."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = make(30), []
    for _ in range(40):
        texts.append("\n".join(make(rng.randint(6, 30)) for _ in range(rng.randint(1, 4))))
    texts += texts[:4] + [t.replace(t.split(" ")[3], "changed", 1) for t in texts[4:10]]
    for _ in range(3):  # a single long line, and near copies of it
        line = make(90).split(" ")
        texts += [" ".join(line), " ".join([*line[:40], "changed", *line[41:]]), " ".join([*line[:60], "other", *line[61:]])]
    texts += [f"{make(15)} {passage} {make(10)}" for _ in range(4)] + [f"{make(9)}\nthe very same line in many texts\n{make(12)}" for _ in range(5)]
    texts += ["!!! ".join(make(40).upper().split(" ")) for _ in range(12)] + [None, "", " \n", make(6000), "Read more\n" + make(20), "Read more"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, make(50), None, None, None)]
    labels = [(i, int("!!!" not in (t or "")) if i % 11 else None, 0) for i, t in enumerate(texts)] + [(9999, 1, 0)]
    return docs, labels, [(1, passage), (2, None), (None, make(20))]


def written(spark, tables, folder, empty=False):
    docs, labels, items = tables
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        df = spark.createDataFrame(rows, schema)
        (df.limit(0) if empty else df).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run(spark, tables, tmp_path):
    folder = written(spark, tables, tmp_path)
    docs, labels, items = tables
    weights = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    rows = [(i, t) for i, t, *_ in docs if quality.scores(weights, [t])[0] >= quality.CUTOFF]
    assert 40 < len(rows) < len(docs) - 8
    for stage in (without_lines, one_of_each_group, lambda r: clean(r, [t for _, t in items])):
        before, rows = len(rows), stage(rows)
        assert 0 < len(rows) < before
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    of = {d[0]: d[2:4] for d in docs}
    by_id = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *of[i], None if t is None else library.encode(t)) for i, t in rows), key=by_id)
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "lang", "source", "ids", "n_pieces", "round_trip").collect()), key=by_id)
    assert got == [(*w, len(w[3] or []), True) for w in want]


def test_run_of_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tables, tmp_path, empty=True)).count() == 0


def test_stages_bear_repeats_and_extra_columns(spark, tables, tmp_path):
    folder = written(spark, tables, tmp_path)
    docs = spark.createDataFrame([(*d, "x", "y", 1.0) for d in tables[0]], f"{SCHEMA}, id string, `text hash` string, score double")
    docs = docs.unionByName(docs.filter("doc_id in (1, 2)"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "sentencepiece":
            assert out.columns == ["doc_id", "lang", "source", "ids", "n_pieces", "round_trip"] and out.count() == docs.count()
            assert {(r["ids"] is None, r["n_pieces"]) for r in out.join(docs.filter("text IS NULL OR text = ''").select("doc_id"), "doc_id").collect()} == {(True, 0), (False, 0)}
        else:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            rows = [r["doc_id"] for r in out.collect()]
            once = name == "minhash near-dedup"
            assert rows.count(1) == (1 if once else 2) and set(rows) <= {d[0] for d in tables[0]}


def test_quality_stage_drops_what_scores_low(spark, tables, tmp_path):
    folder = written(spark, tables, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    junk = {i for i, t, *_ in tables[0] if "!!!" in (t or "")}
    assert not kept & junk and len(kept) >= len(tables[0]) - len(junk) - 3


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_held_out_quality_and_language(spark):
    """What README says of documents that were not learned from."""
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    scored = quality.query(spark, str(DATA)).filter("held_out").join(labels.filter("quality IS NOT NULL"), "doc_id").select("score", "quality").toPandas()
    rank = scored["score"].rank()
    good = scored["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99
    named = language_id.query(spark, str(DATA)).filter("held_out").join(docs.filter("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    right = named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


def test_lines_of_long_ids_beside_null_ones(spark):
    big = (1 << 60) + 1
    rows = [(big, "a line of text that is long enough, one"), (big + 1, "a line of text that is long enough, ona"), (None, "something else altogether, and also long"), (None, "yet another one that is like none of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["text"]: r["n_dropped"] for r in line_dedup.deduplicate_lines(docs).filter("doc_id IS NOT NULL").collect()}
    assert got == {rows[0][1]: 0, "": 1}


def test_url_rules_as_long_as_each_other(spark):
    df = spark.createDataFrame([(1, "http://ab.cd/xyz")], "page_id long, url string")
    for rules in ([("allow", "ab.cd/"), ("block", "cd/xyz")], [("block", "cd/xyz"), ("allow", "ab.cd/")]):
        assert url_filter.filter_urls(df, rules=rules).first()["rule"] == "ab.cd/"


def test_names_with_dots(spark):
    rows = [(i, f"some words of a text number {i} " * 9, "en", f"http://casino.org/{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "`an.id` long, `a.text` string, `a.lang` string, `an.url` string")
    names = {"id_col": "an.id", "text_col": "a.text"}
    weights = quality.fit(df, df.select("`an.id`", F.lit(1).alias("a.label")), F.lit(True), label_col="a.label", **names)
    assert quality.score(df, weights, text_col="a.text").count() == 8
    assert url_filter.filter_urls(df, "an.id", "an.url").columns[0] == "an.id"
    assert near_dedup.near_duplicates(df, **names).select("`an.id`").count() == 8
    model = language_id.fit(df, F.lit(True), "an.id", "a.text", "a.lang")
    assert {r["lang_pred"] for r in language_id.identify(df, model, **names).collect()} == {"en"}
    items = spark.createDataFrame([(1, rows[3][1])], "`i.id` long, `i.text` string")
    found = decontaminate.contamination(df, items, item_col="i.id", item_text_col="i.text", **names)
    assert found.filter("contaminated").count() >= 1 and found.columns[0] == "an.id"


def test_covered_places(spark):
    rng = random.Random(3)
    spans = [[(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))] for _ in range(40)]
    df = spark.createDataFrame([(s,) for s in spans], "spans array<struct<lo:int,hi:int>>")
    got = [r[0] for r in df.select(decontaminate.covered(F.array_sort("spans"))).collect()]
    assert got == [len({x for a, b in s for x in range(a, b + 1)}) for s in spans]


def test_batches_for_python_are_bounded(spark):
    from tidewell.llm import common

    spark.conf.unset(common.BATCH)
    common.bounded_batches(spark)
    assert spark.conf.get(common.BATCH) in ("4m", "4194304b", "4194304")
    spark.conf.set(common.BATCH, "9m")
    common.bounded_batches(spark)
    assert spark.conf.get(common.BATCH).startswith("9")
    spark.conf.unset(common.BATCH)



def test_snapshots_persist(spark, tmp_path):
    """Three snapshots of other sizes, written once; batches are held against them and their copies grouped apart."""
    import shutil

    rng = random.Random(17)
    texts = [f"text {i} {'é' * rng.randint(0, 5)}" for i in range(400)]
    schema = "doc_id long, text string, digest string"
    frame = lambda rows: spark.createDataFrame([(i, t, "x") for i, t in rows], schema)
    parts = [[(i, texts[i]) for i in range(150)] + [(900, texts[3])], [(1000 + i, texts[i]) for i in range(140, 260)] + [(None, None)], []]
    paths = [str(tmp_path / str(k)) for k in range(3)]
    for rows, path in zip(parts, paths, strict=True):
        exact_dedup.write_snapshot(frame(rows), path, bucket_keys=40)
    batch = [(5000 + i, texts[i]) for i in range(100, 330)] + [(1, texts[300]), (6000, None), (6001, ""), (None, texts[310]), (7000, texts[320]), (7000, texts[320])]
    known = [{t or "": max(i for i, u in rows if u == t and i is not None) if t else None for _, t in rows} for rows in parts]
    want = []
    for i, t in batch:
        group = [j for j, u in batch if (u or "") == (t or "")]
        at = max((k for k in range(3) if (t or "") in known[k]), default=None)
        largest = max((j for j in group if j is not None), default=None)
        want.append((i, len(group), at, None if at is None else known[at][t or ""], at is None and i == largest))
    got = exact_dedup.screen_batch(frame(batch), paths).drop("text_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)

    new = [(i, f"never seen before {i}") for i in range(30)]
    found = exact_dedup.screen_batch(frame(new), paths[:1])
    if found.filter("known_in IS NOT NULL").count() == 0:  # one key in 256 passes a filter by chance: then older texts are read
        keys = {r["text_sha256"] for r in found.collect()}
        assert len(keys) == 30
    shutil.rmtree(f"{paths[2]}/exact")  # nothing passes the filters of an empty snapshot: its texts are not read
    assert exact_dedup.screen_batch(frame(new), paths[2:]).filter("kept").count() == 30
    assert exact_dedup.screen_batch(frame([]), paths).count() == 0
    assert exact_dedup.screen_batch(frame(new), []).filter("kept").count() == 30
