"""Operators that SQL does not cover: streams against their batch form, files, folds, masks, merges."""

from __future__ import annotations

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import relational, retrieval
from tidewell.sources import files
from tidewell.streaming import conversations


def run_stream(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + datetime.timedelta(minutes=7 * i)) for i in range(60)]
    rows.append((99, 9, start + datetime.timedelta(days=3)))  # lets the watermark pass all others
    df = spark.createDataFrame(rows, "id long, session long, ts timestamp")
    folder = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        df.filter(F.col("id").between(20 * k, 20 * k + 19) | ((F.col("id") == 99) & F.lit(k == 2))).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def both(events, spark, f, name):
    df, folder = events
    batch = {tuple(r) for r in f(df).collect()}
    stream = {tuple(r) for r in run_stream(f(conversations.read_stream(spark, folder, df.schema)), name).collect()}
    return batch, stream


def test_windows_as_a_stream(spark, events):
    batch, stream = both(events, spark, lambda d: conversations.windowed_counts(d, ["session"], "1 hour", "30 minutes"), "windows")
    assert stream and {r for r in batch if r[1] != 9} == stream


def test_sessions_as_a_stream(spark, events):
    batch, stream = both(events, spark, lambda d: conversations.sessions(d, ["session"], "15 minutes"), "sessions")
    assert stream and {r for r in batch if r[0] != 9} == stream


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """Conversations in three files, each with turns of all: overlaps, repeats, same roles, spam, nulls."""
    texts = ["I would like to ask about my card and its fee", "like to ask about my card and its fee for this year", "Of course, one moment please", "Of course, one moment please.", "aaaaaaaaaaaa", None, "and the limit?", "It is two thousand", "Thank you"]
    roles = ["user", "user", "agent", "agent", "user", "user", "user", "agent", None]
    rows = [(c, t, roles[(t + c) % 9] if c else roles[t], texts[(t + c) % 9]) for c in range(4) for t in range(9 + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folder = str(tmp_path_factory.mktemp("talk"))
    for k in range(3):
        df.filter(F.col("turn").between(5 * k, 5 * k + 4)).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def test_micro_batches_as_a_stream(spark, talk):
    df, folder = talk
    batch = {tuple(r) for r in conversations.micro_batches(df.fillna({"text": ""}), "conv_id", "turn", "text").collect()}
    stream = {tuple(r) for r in run_stream(conversations.micro_batches_stream(conversations.read_stream(spark, folder, df.schema)), "micro").collect()}
    flushed = conversations.in_order(df, "conv_id", ["turn"], lambda k, f, s: conversations.batched(k, f, s, 3, None), "conv_id long, batch long, text string", flush=True)
    assert {tuple(r) for r in flushed.collect()} == batch
    assert stream == {r for r in batch if (r[1] + 1) * 3 <= 9 + r[0]} and stream < batch


def test_merged_turns_as_a_stream(spark, talk):
    df, folder = talk
    want = set()
    for c in range(4):
        turns = [(r["role"] or "", r["text"] or "") for r in df.filter(F.col("conv_id") == c).orderBy("turn").collect()]
        want |= {(c, i, *t) for i, t in enumerate(conversations.merge_turns(turns))}
    assert {tuple(r) for r in conversations.merge_overlaps(df).collect()} == want
    stream = {tuple(r) for r in run_stream(conversations.merge_overlaps_stream(conversations.read_stream(spark, folder, df.schema)), "merged").collect()}
    last = {c: max(t[1] for t in want if t[0] == c) for c in range(4)}
    assert stream == {t for t in want if t[1] < last[t[0]]}  # the open turn waits for silence


def test_carried_value_as_a_stream(spark, events):
    df, folder = events
    with_value = lambda d: d.withColumn("value", F.when(F.col("id") % 4 == 0, F.concat(F.lit("v"), F.col("id"))))
    batch = {(r["session"], r["id"], r["carried"]) for r in conversations.carried(with_value(df), "session", ["ts", "id"], "ts", "value", 2400, 2).collect()}
    stream = with_value(conversations.read_stream(spark, folder, df.schema)).withColumn("at", F.unix_timestamp("ts").cast("double"))
    assert {tuple(r) for r in run_stream(conversations.carried_stream(stream, 2400, 2), "carried").collect()} == batch
    assert len({r[2] is None for r in batch}) == 2


def test_evictions_as_a_stream(spark, events):
    df, folder = events
    pick = lambda d: d.select("session", "id", F.unix_timestamp("ts").cast("double").alias("at"))
    table = conversations.in_order(pick(df), "session", ["at", "id"], lambda k, f, s: conversations.evicting(k, f, s, 3600 * 2, 4), "session long, id long, reason string")
    batch = {tuple(r) for r in table.collect()}
    want = set()
    for s in range(3):
        ids = [i for i in range(60) if i % 3 == s]
        for n, _ in enumerate(ids):
            want |= {(s, i) for i in ids[: n + 1] if 7 * (ids[n] - i) >= 120} | {(s, i) for i in ids[: max(0, n + 1 - 4)]}
    assert {r[:2] for r in batch} == want
    assert {tuple(r) for r in run_stream(conversations.evictions_stream(pick(conversations.read_stream(spark, folder, df.schema)), 3600 * 2, 4), "evicted").collect()} == batch


def test_alignment_of_two_transcripts(spark):
    turns = lambda rows: spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    said = turns([("agent", "good morning how can I help"), ("user", "my card is lost")])
    heard = turns([("agent", "good morning can I help my"), ("user", "card is lst")])
    got = {(r["role"], r["heard"]): r["n"] for r in conversations.alignment(said, heard).collect()}
    assert got == {("agent", "agent"): 4 + 7 + 3 + 1 + 4, ("agent", "missed"): 3, ("user", "agent"): 2, ("user", "user"): 4 + 2, ("user", "missed"): 4}
    assert conversations.alignment(said.limit(0), heard).count() == 0


def test_store_with_expiry_and_refresh(spark, tmp_path):
    store = spark.createDataFrame([(1, "a", 50.0), (2, "b", 200.0), (3, "c", 200.0)], "id long, value string, expires double")
    new = spark.createDataFrame([(3, "d")], "id long, value string")
    assert {tuple(r) for r in conversations.put(store, new, "id", 60.0, 100.0).collect()} == {(2, "b", 200.0), (3, "d", 160.0)}
    refresh = conversations.refresher(lambda s: s.range(7).agg(F.sum("id").alias("total")), str(tmp_path))
    for number in (0, 1, 1):
        refresh(store, number)
    assert [spark.read.parquet(f"{tmp_path}/version={n}").first()["total"] for n in (0, 1)] == [21, 21]


def test_cooldown_as_a_stream(spark, events):
    df, folder = events
    pick = lambda d: d.select("session", "id", F.unix_timestamp("ts").cast("double").alias("at"))
    batch = {tuple(r) for r in conversations.throttle(pick(df), 3600.0).collect()}
    stream = {tuple(r) for r in run_stream(conversations.throttle_stream(pick(conversations.read_stream(spark, folder, df.schema)), 3600.0), "cooldown").collect()}
    assert batch == stream and {r[3] for r in batch} == {True, False}


def test_upsert_sink(spark, tmp_path):
    path = str(tmp_path / "table")
    write = conversations.upsert_sink(path, lambda old, new: relational.upsert(old, new, ["id"]))
    write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    for _ in range(2):  # a batch that is run again
        write(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), 1)
    assert {tuple(r) for r in spark.read.parquet(f"{path}/version=1").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_upsert_keeps_old(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, v string, n int")
    new = spark.createDataFrame([(1, None, None), (3, "c", 7)], "id int, v string, n int")
    assert {tuple(r) for r in relational.upsert(old, new, ["id"], ["n"]).collect()} == {(1, None, 5), (2, "b", None), (3, "c", 7)}


def test_merge_turns():
    long = "and then we looked at the account again"
    got = conversations.merge_turns([("user", "hello there"), ("user", "hello there"), ("agent", f"so {long}"), ("user", f"{long} and more"), ("user", "aaaaaaaaaaaa"), ("user", ""), ("user", "more")])
    assert got == [("user", "hello there"), ("agent", f"so {long}"), ("user", "and more more")]


def test_durations(spark):
    df = spark.createDataFrame([("1:02",), ("1:00:05",), ("x",), ("",), (None,), ("5",)], "d string")
    assert [r[0] for r in df.select(relational.duration_seconds("d")).collect()] == [62, 3605, 0, 0, 0, 0]
    assert spark.range(1).select(relational.format_duration(F.lit(125))).first()[0] == "2:05"


def test_masks(spark):
    cases = {"*" * 16: "[CARD]", "*" * 13: "[ACCOUNT]", "*" * 11: "[MOBILE]", "*" * 10: "[NUMBER]", "*" * 5: "[MASK]", "*" * 40: "[MASK]", "**": "**"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.normalise_masks(F.col("t")))
    assert dict(map(tuple, df.collect())) == cases


def test_pack(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccc", "d", "eeeeeeeee", "f"],), ([],)], "p array<string>").select(text.pack(F.col("p"), 6))
    assert [r[0] for r in df.collect()] == [["aa bb", "cccc d", "eeeeeeeee", "f"], []]


def test_html(spark):
    page = '<html><head><style>p{}</style><script>var a="</p>";</script></head><body><p>A &amp;lt; b</p>\n<p>c</p></body></html>'
    assert spark.createDataFrame([(page,)], "h string").select(text.strip_tags(F.col("h"))).first()[0] == "A &lt; b c"


def test_fusion_and_lookup(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "q int, d int, rank int")
    got = {r["d"]: r["score"] for r in retrieval.reciprocal_rank_fusion({"a": (ranks([(1, 1, 1), (1, 2, 2)]), 0.5), "b": (ranks([(1, 2, 1)]), 0.5)}, ["q", "d"]).collect()}
    assert got[2] == pytest.approx(0.5 / 62 + 0.5 / 61) and got[1] == pytest.approx(0.5 / 61)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string").collect()] == [(1, 'x, "y"'), (2, None)]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": ["a"]}, {"id": 2}]))
    assert [tuple(r) for r in files.read_json_array(spark, str(tmp_path / "a.json"), "id int, t array<string>").collect()] == [(1, ["a"]), (2, None)]
    (tmp_path / "a.md").write_text("## One\nbody 1\n\n## Two\nbody 2\n")
    assert [tuple(r)[1:] for r in files.read_sections(spark, str(tmp_path / "a.md")).collect()] == [(0, "One", "body 1"), (1, "Two", "body 2")]
    assert files.read_binary(spark, str(tmp_path / "a.md")).first()["length"] == 29
    out = str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(2, "x"), (3, "c")], [(3, "c")]):
        files.append_new(spark.createDataFrame(rows, "id int, v string"), out, ["id"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    files.write_csv(spark.read.parquet(out), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "id int, v string").count() == 3


def test_islands_and_budget(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "o": range(6), "v": list("aabbaa"), "n": [1, 2, 3, 4, 5, 6]}))
    assert [r["island"] for r in relational.islands(df, ["g"], ["o"], "v").orderBy("o").collect()] == [1, 1, 2, 2, 3, 3]
    assert relational.bounded(df, ["g"], ["o"], F.col("n"), 7).count() == 3


def test_numbered_over_range_partitions(spark):
    rows = [(k % 3 if k % 10 else None, (k * 37) % 101 if k % 7 else None, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, v long, id long")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    got = {r["id"]: r["n"] for r in relational.numbered(df, [F.desc_nulls_last("v"), F.col("id")], "n").collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(order)}
    grouped = {r["id"]: r["n"] for r in relational.numbered(df, [F.desc_nulls_last("v"), F.col("id")], "n", ["g"]).collect()}
    assert grouped == {r[2]: i + 1 for g in (0, 1, 2, None) for i, r in enumerate(x for x in order if x[0] == g)}
    before = {r["id"]: r["b"] for r in relational.running_before(df, ["id"], "id", "b").collect()}
    assert before == {k: sum(range(k)) for k in range(300)}
    assert relational.numbered(df.limit(0), [F.col("id")], "n", ["g"]).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for i in range(120)] + [(500, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    q = df.filter("id % 5 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    found = lambda: {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9)) for r in retrieval.knn(q, df.select(F.col("id").alias("doc"), "v"), 4, "query", "qv", "doc", "v").collect()}
    sent = {k: v[1] for k, v in found().items()}
    monkeypatch.setattr(retrieval, "SEND_QUERIES", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    assert {k: v[1] for k, v in found().items()} == sent and len(sent) == 25 * 4


def test_nested_json(spark):
    rows = [
        (1, '{"a": null, "b": "", "c": [null, "", {"d": []}], "e": {"f": {"g": "x "}}, "n": 0, "t": false}', '{"e":{"f":{"g":"x"}},"n":0,"t":false}'),
        (2, "[[], {}, null]", None),
        (3, "no json", None),
        (4, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id long, j string")
    assert {r["id"]: r["p"] for r in df.select("id", text.json_pruned(F.col("j")).alias("p")).collect()} == {r[0]: r[2] for r in rows}
    out = spark.createDataFrame([('{"see": ["see here, see", {"k": "see more below"}], "n": 1}',)], "j string")
    assert out.select(text.json_without(F.col("j"), ("see", "see more"))).first()[0] == '{"see":["here,",{"k":"below"}],"n":1}'
    arrays = [("Sure: [{\"a\": 1}, {\"b\": [2, {\"c\": \"]\"}]}] done {\"x\": 1}", ['{"a":1}', '{"b":[2,{"c":"]"}]}']), ('[{"a": 1}, {"b": "cut', ['{"a":1}']), ("[]", []), ("none", []), (None, [])]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in arrays], "j string").coalesce(1).select(text.json_objects(F.col("j"))).collect()]
    assert got == [b for _, b in arrays]


def test_section_chunks(spark):
    doc = "intro text\n# First\none.\n\n" + "A sentence of some length. " * 8 + "\n\nlast paragraph\n## Second\n" + "y" * 170
    got = spark.createDataFrame([(doc,)], "t string").select(F.inline(text.section_chunks(F.col("t"), 20))).collect()
    assert all(len(r["text"]) <= 80 for r in got)
    assert [r["heading"] for r in got if r["text"].startswith(("intro", "one.", "y"))] == ["", "First", "Second", "Second", "Second"]
    assert "".join("".join(r["text"] for r in got).split()) == "".join(doc.replace("# First", "").replace("## Second", "").replace("#", "").split())


def test_folder_as_chunks_with_running_ids(spark, tmp_path):
    for name, body in (("b.txt", "One. Two two. Three."), ("a.txt", "Only one.")):
        (tmp_path / name).write_text(body)
    got = files.load_chunks(spark, str(tmp_path), 12, 10).orderBy("id").collect()
    assert [(r["id"], r["path"][-5:], r["chunk"], r["text"]) for r in got] == [(11, "a.txt", 0, "Only one."), (12, "b.txt", 0, "One."), (13, "b.txt", 1, "Two two."), (14, "b.txt", 2, "Three.")]
