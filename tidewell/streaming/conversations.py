"""Conversation and event streams: windows, sessions, keyed state, sinks.

Windows and sessions work on a stream as on a table. Keyed operators have a form for each, which share their step: over a
stream it keeps its state from batch to batch, over a table it goes through each key's rows in order.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def read_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(df: DataFrame, keys: Sequence[str], length: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Events by key and window; late ones are waited for by LATE."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.withWatermark(ts, LATE).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, keys: Sequence[str], gap: str, ts: str = "ts") -> DataFrame:
    """Events by key, in sessions that end after a gap."""
    g = df.withWatermark(ts, LATE).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), "n")


def micro_batches(df: DataFrame, key: str, order: str, text: str, size: int = 3) -> DataFrame:
    """Fragments joined in batches of ``size`` in order of arrival; the last batch may be shorter. Its stream form is micro_batches_stream."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    g = df.withColumn("batch", F.floor(n / size)).groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    return g.select(key, "batch", F.array_join(f"parts.{text}", " ").alias("text"))


def _frames(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> Iterator[tuple]:
    for pdf in frames:
        yield from pdf.sort_values(list(order)).itertuples(index=False)


def _set(state: GroupState, value: tuple, silence: int | None) -> None:
    state.update(value)
    if silence:
        state.setTimeoutDuration(1000 * silence)


def batched(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, size: int, silence: int | None) -> Iterator[pd.DataFrame]:
    """One conversation's fragments: a batch each time ``size`` are there, and what is left after a silence."""
    number, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], number, " ".join(held))] if held else [], columns=["conv_id", "batch", "text"])
        return
    out = []
    for r in _frames(frames, ["turn"]):
        held.append(r.text or "")
        if len(held) == size:
            out.append((key[0], number, " ".join(held)))
            number, held = number + 1, []
    _set(state, (number, json.dumps(held)), silence)
    yield pd.DataFrame(out, columns=["conv_id", "batch", "text"])


def _timeout(silence: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout


def micro_batches_stream(df: DataFrame, size: int = 3, silence: int | None = None) -> DataFrame:
    """(conv_id, turn, text) of a stream in batches; with ``silence`` seconds, a conversation's rest follows after these."""
    return df.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(lambda k, f, s: batched(k, f, s, size, silence), "conv_id long, batch long, text string", "number long, held string", "append", _timeout(silence))


def carried(df: DataFrame, key: str, order: Sequence[str], ts: str, value: str, max_age: int, max_turns: int) -> DataFrame:
    """The last known value of a session, as long as it is at most ``max_age`` seconds and ``max_turns`` turns old. Its stream form is carried_stream."""
    w = Window.partitionBy(key).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    t = df.withColumn("turn ", F.row_number().over(w))
    seen = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), F.col(ts).alias("ts"), F.col("turn ").alias("turn"))), ignorenulls=True).over(past)
    t = t.withColumn("seen ", seen)
    fresh = (seconds(F.col(ts)) - seconds(F.col("`seen `.ts")) <= max_age) & (F.col("turn ") - F.col("`seen `.turn") <= max_turns)
    return t.withColumn("carried", F.when(fresh, F.col("`seen `.value"))).drop("turn ", "seen ")


def carrying(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, max_age: float, max_turns: int) -> Iterator[pd.DataFrame]:
    """One session's events in order: each with the last known value, if it is fresh."""
    value, seen, at_turn, turn = state.get if state.exists else (None, 0.0, 0, 0)
    out = []
    for r in _frames(frames, ["at", "id"]):
        turn += 1
        if r.value is not None and not pd.isna(r.value):
            value, seen, at_turn = r.value, r.at, turn
        fresh = value is not None and r.at - seen <= max_age and turn - at_turn <= max_turns
        out.append((key[0], r.id, value if fresh else None))
    state.update((value, seen, at_turn, turn))
    yield pd.DataFrame(out, columns=["session", "id", "carried"])


def carried_stream(df: DataFrame, max_age: float, max_turns: int) -> DataFrame:
    """(session, id, at, value) of a stream, with the value carried forward; the state is the last one, its time and turn."""
    return df.select("session", "id", "at", F.col("value").cast("string").alias("value")).groupBy("session").applyInPandasWithState(lambda k, f, s: carrying(k, f, s, max_age, max_turns), "session long, id long, carried string", "value string, seen double, at_turn long, turn long", "append", GroupStateTimeout.NoTimeout)


def latest(df: DataFrame, key: str, ts: str, ttl: str, at: str, most: int) -> DataFrame:
    """Entries of a table younger than ``ttl``, and of those the ``most`` latest. A stream evicts by evictions_stream."""
    alive = df.filter(F.col(ts) > F.expr(f"timestamp_ntz'{at}' - interval {ttl}"))
    return alive.orderBy(F.desc(ts), key).limit(most)


def evicting(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl: float, most: int) -> Iterator[pd.DataFrame]:
    """One session's entries in order: what leaves it, for age or as the oldest of more than ``most``."""
    alive = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
    out = []
    for r in _frames(frames, ["at", "id"]):
        alive.append((int(r.id), float(r.at)))
        while alive and (alive[0][1] <= r.at - ttl or len(alive) > most):
            i, at = alive.pop(0)
            out.append((key[0], i, "age" if at <= r.at - ttl else "size"))
    state.update((json.dumps(alive),))
    yield pd.DataFrame(out, columns=["session", "id", "reason"])


def evictions_stream(df: DataFrame, ttl: float, most: int) -> DataFrame:
    """(session, id, at) of a stream: entries that leave their session; the state holds ``most`` entries at most."""
    return df.select("session", "id", "at").groupBy("session").applyInPandasWithState(lambda k, f, s: evicting(k, f, s, ttl, most), "session long, id long, reason string", "alive string", "append", GroupStateTimeout.NoTimeout)


#: Any of these lets an event through, once the cooldown is over.
TRIGGERS = {"hits": 2.0, "confidence": 0.7, "turn": 4.0}


def triggered(hits: str = "hits", confidence: str = "confidence", turn: str = "turn", wanted: str = "wanted") -> Column:
    """Whether an event may fire: it is wanted, or has hits, confidence or turns enough; a null is none."""
    enough = [F.col(c) >= TRIGGERS[name] for name, c in (("hits", hits), ("confidence", confidence), ("turn", turn))]
    return F.coalesce(F.col(wanted), F.lit(False)) | reduce(or_, (F.coalesce(e, F.lit(False)) for e in enough))


def cooled(key, frames: Iterator[pd.DataFrame], state: GroupState, seconds: float) -> Iterator[pd.DataFrame]:
    """One session's events in order of arrival: whether each fires, which it does if it may and the last that fired is ``seconds`` past."""
    last = state.get[0] if state.exists else float("-inf")
    for pdf in frames:
        fired = []
        for t, may in zip(pdf["at"], pdf["may"], strict=True):
            fire = bool(may) and t - last >= seconds
            last = t if fire else last
            fired.append(fire)
        yield pdf.drop(columns="may").assign(fired=fired)
    state.update((last,))


def may_fire(df: DataFrame) -> DataFrame:
    return df.select("session", "id", "at", F.coalesce(F.col("may"), F.lit(False)).alias("may") if "may" in df.columns else F.lit(True).alias("may"))


def throttle_stream(df: DataFrame, seconds: float = 12.0) -> DataFrame:
    """(session, id, at) of a stream, and ``may`` if not all may fire, with ``fired``; the state is the time of the last that fired."""
    return may_fire(df).groupBy("session").applyInPandasWithState(lambda k, f, s: cooled(k, (x.sort_values(["at", "id"]) for x in f), s, seconds), "session long, id long, at double, fired boolean", "last double", "append", GroupStateTimeout.NoTimeout)


class Held:
    """The state of one key of a table that is read in order."""

    def __init__(self) -> None:
        self.exists, self.hasTimedOut, self.get = False, False, None

    def update(self, value: tuple) -> None:
        self.exists, self.get = True, value

    def remove(self) -> None:
        self.exists = False


def in_order(df: DataFrame, key: str, order: Sequence[str], step: Callable, schema: str, flush: bool = False) -> DataFrame:
    """The table form of a keyed-state step: rows sorted by key and order, in Arrow batches; a task holds one key's state.

    A key is never held whole, however many rows it has. With ``flush``, the step is told when a key has ended. Keys go
    through Python as text beside a null flag, so that a null key is one key and long ones stay exact; the step gets None
    for null and else the key as text, and what it returns as the key's column is cast back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Held()

        def end() -> Iterator[pd.DataFrame]:
            if flush and now is not None:
                state.hasTimedOut = True
                yield from step((now[1],), iter(()), state)

        for batch in batches:
            keys = [None if pd.isna(k) else k for k in batch[key]]
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if now is None or keys[a] != now[1]:
                    yield from end()
                    now, state = (True, keys[a]), Held()
                yield from step((keys[a],), iter([batch.iloc[a:b]]), state)
        yield from end()

    kind = dict(df.dtypes)[key]
    rows = df.withColumn("sort ", F.col(key)).repartition(key).sortWithinPartitions("sort ", *order).withColumn(key, F.col(key).cast("string")).drop("sort ")
    plain = df.sparkSession.createDataFrame([], schema)
    text = ", ".join(f"`{n}` {'string' if n == key else t}" for n, t in plain.dtypes)
    return rows.mapInPandas(run, text).withColumn(key, F.col(key).cast(kind))


def throttle(df: DataFrame, seconds: float = 12.0) -> DataFrame:
    """The same over a table."""
    step = lambda k, f, s: cooled(k, f, s, seconds)
    return in_order(may_fire(df), "session", ["at", "id"], step, "session long, id long, at double, fired boolean")


def alike(a: str, b: str, least: float) -> bool:
    """Nearly equal; the cheap bounds are tried first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def overlap(a: str, b: str, least: int = 12, near: float = 0.92) -> int:
    """Characters at b's start that repeat a's end, letting for some difference."""
    starts = [i for i in range(max(0, len(a) - len(b)), len(a) - least + 1) if a.startswith(b[:3], i)]  # the longest first
    return next((len(a) - i for i in starts if alike(a[i:], b[: len(a) - i], near)), 0)


def merge_step(last: tuple[str, str] | None, role: str, text: str, near: float = 0.95) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
    """(a turn that is finished, the one that is open) after one more turn.

    A turn nearly equal to the open one goes, a repeated beginning is cut, and one of the same role joins it.
    """
    if not text or (len(text) >= 10 and len(set(text)) <= 2) or (last and alike(last[1], text, near)):
        return None, last
    if last:
        text = text[overlap(last[1][-200:], text[:200]) :]
    if last and last[0] == role:
        return None, (role, f"{last[1]} {text}".strip())
    return (last, (role, text)) if text else (None, last)


def merge_turns(turns: Sequence[tuple[str, str]], near: float = 0.95) -> list[tuple[str, str]]:
    """All finished turns of a conversation, in order."""
    kept, last = [], None
    for role, text in turns:
        done, last = merge_step(last, role, text, near)
        kept += [done] if done else []
    return kept + ([last] if last else [])


def merging(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, silence: int | None) -> Iterator[pd.DataFrame]:
    """One conversation's turns: each when the next one begins, the last one after a silence."""
    number, role, text = state.get if state.exists else (0, None, None)
    last, out = None if role is None else (role, text), []
    if state.hasTimedOut:
        state.remove()
        out += [(key[0], number, *last)] if last else []
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text"])
        return
    for r in _frames(frames, ["turn"]):
        done, last = merge_step(last, r.role or "", r.text or "")
        if done:
            out.append((key[0], number, *done))
            number += 1
    _set(state, (number, *(last or (None, None))), silence)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text"])


TURNS = "conv_id long, turn long, role string, text string"


def merge_overlaps(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each conversation of a table after merge_turns."""
    return in_order(df.select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], lambda k, f, s: merging(k, f, s, None), TURNS, flush=True)


def merge_overlaps_stream(df: DataFrame, silence: int | None = None) -> DataFrame:
    """The same of a stream; a conversation's last turn follows after ``silence`` seconds. The state is the open turn."""
    return df.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(lambda k, f, s: merging(k, f, s, silence), TURNS, "number long, role string, text string", "append", _timeout(silence))


def alignment(said: DataFrame, heard: DataFrame) -> DataFrame:
    """conv_id, role, heard, n: characters of aligned words by their role in two transcripts; ``missed`` are those without a match.

    Words are aligned in order of turns; an alignment needs both transcripts of a conversation in one task.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        words = [[(w, r.role or "") for r in x.sort_values("turn").itertuples() for w in (r.text or "").split()] if len(x) else [] for x in (a, b)]
        n = Counter()
        got = [None] * len(words[0])
        for i, j, size in SequenceMatcher(None, [w for w, _ in words[0]], [w for w, _ in words[1]], autojunk=False).get_matching_blocks():
            for k in range(size):
                got[i + k] = words[1][j + k][1]
        for (w, role), other in zip(words[0], got, strict=True):
            n[role, "missed" if other is None else other] += len(w)
        return pd.DataFrame([(a["conv_id"].iloc[0], *k, c) for k, c in sorted(n.items())] if len(a) else [], columns=["conv_id", "role", "heard", "n"])

    columns = ("conv_id", "turn", "role", "text")  # named anew: both may come from one table
    said, heard = (x.select(*(F.col(c).alias(c) for c in columns)) for x in (said, heard))
    return said.groupBy("conv_id").cogroup(heard.groupBy("conv_id")).applyInPandas(run, "conv_id long, role string, heard string, n long")


#: Neighbouring parts by which equal runs are found; shorter runs only count where there is none of this length.
RUN = 3
#: Pairs of equal parts that are held at once, for each part of the two texts.
RUN_PAIRS = 64


def equal_runs(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray | None:
    """(place in a, place in b, length) of the longest equal runs at their places, of ``size`` or more; None if there are too many pairs."""
    if min(len(a), len(b)) < size:
        return np.zeros((0, 3), dtype=np.int64)
    x, y, parts = a, b, max(a.max(), b.max()) + 1
    for k in range(1, size):  # grams of one part more, numbered anew
        codes = np.unique(np.concatenate([c[:-1] * parts + t[k:] for c, t in ((x, a), (y, b))]), return_inverse=True)[1]
        x, y = codes[: len(a) - k], codes[len(a) - k :]
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
    n = high - low
    if n.sum() > RUN_PAIRS * (len(a) + len(b)):
        return None
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    by = np.lexsort((i, i - j))  # along each diagonal
    i, j = i[by], j[by]
    first = np.ones(len(i), dtype=bool)
    first[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(first)
    return np.stack([i[at], j[at], np.diff(np.append(at, len(i))) + size - 1], axis=1)


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of equal runs, as difflib's SequenceMatcher (without junk) gives them.

    It takes the longest run, of several the first in a, then in b, and goes on left and right of it. Runs of RUN parts and
    more are found once, by their grams; a stretch without such a run is left to difflib, as are texts that repeat so much
    that the runs would not fit in memory.
    """
    if list(a) == list(b):
        return [(0, 0, len(a))] if len(a) else []
    number: dict = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in (a, b))
    runs = equal_runs(x, y, RUN)
    todo, out = [(0, len(a), 0, len(b), runs)], []
    while todo:
        alo, ahi, blo, bhi, held = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        if held is not None and len(held):
            skip = np.maximum(0, np.maximum(alo - held[:, 0], blo - held[:, 1]))
            size = np.minimum(held[:, 2], np.minimum(ahi - held[:, 0], bhi - held[:, 1])) - skip
            keep = size >= RUN
            held, size, skip = held[keep], size[keep], skip[keep]
        if held is None or not len(held):
            out += [(alo + m.a, blo + m.b, m.size) for m in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks() if m.size]
            continue
        longest = np.flatnonzero(size == size.max())
        i, j = min(zip((held[longest, 0] + skip[longest]).tolist(), (held[longest, 1] + skip[longest]).tolist(), strict=True))
        n = int(size.max())
        out.append((i, j, n))
        todo += [(alo, i, blo, j, held[(held[:, 0] < i) & (held[:, 1] < j)]), (i + n, ahi, j + n, bhi, held[(held[:, 0] + held[:, 2] > i + n) & (held[:, 1] + held[:, 2] > j + n)])]
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
        joined.append((i, j, n))
    return joined


def aligned_places(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of equal stretches: of words first, then of characters in what lies between them."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    words = [[(m.start(), m.end()) for m in re.finditer(r"\S+|\s+", t)] for t in (a, b)]
    texts = [[t[i:j] for i, j in w] for t, w in zip((a, b), words, strict=True)]
    place = lambda side, k: words[side][k][0] if k < len(words[side]) else len((a, b)[side])
    out, at = [], (0, 0)
    for i1, j1, n in [*matching_blocks(*texts), (len(texts[0]), len(texts[1]), 0)]:
        i, j = place(0, i1), place(1, j1)
        if at[0] < i and at[1] < j:
            out += [(at[0] + x, at[1] + y, m) for x, y, m in matching_blocks(a[at[0] : i], b[at[1] : j])]
        at = (place(0, i1 + n), place(1, j1 + n))
        if n:
            out.append((i, j, at[0] - i))
    return out


def stretches(said: Sequence[tuple[str, str]], heard: Sequence[tuple[str, str]]) -> list[tuple]:
    """(start, end, heard start, heard end, role, heard role, turn, heard turn) of aligned characters, cut where a role, turn or the alignment changes; ends are one behind."""
    texts = ["".join(t for _, t in x) for x in (said, heard)]
    begins = [np.cumsum([0, *(len(t) for _, t in x)]) for x in (said, heard)]
    out: list[tuple] = []
    for i, j, size in aligned_places(*texts):
        at = {i, i + size, *(k for k in begins[0].tolist() if i < k < i + size), *(k - j + i for k in begins[1].tolist() if j < k < j + size)}
        for lo, hi in pairwise(sorted(at)):
            x, y = (int(np.searchsorted(b, p, side="right")) - 1 for b, p in ((begins[0], lo), (begins[1], lo - i + j)))
            out.append((lo, hi, lo - i + j, hi - i + j, said[x][0], heard[y][0], x, y))
    return out


STRETCHES = "conv_id {kind}, start long, end long, heard_start long, heard_end long, role string, heard string, turn long, heard_turn long"


def character_alignment(said: DataFrame, heard: DataFrame) -> DataFrame:
    """Stretches of equal characters of two transcripts (conv_id, turn, role, text) of each conversation, with both roles.

    An alignment needs both transcripts of a conversation in one task. A null role or text is empty.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        turns = [[(r.role or "", r.text or "") for r in x.sort_values("turn").itertuples()] for x in (a, b)]
        rows = [(a["conv_id"].iloc[0], *s) for s in stretches(*turns)] if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=["conv_id", "start", "end", "heard_start", "heard_end", "role", "heard", "turn", "heard_turn"])

    said, heard = (x.select(*(F.col(c).alias(c) for c in ("conv_id", "turn", "role", "text"))) for x in (said, heard))
    kind = dict(said.dtypes)["conv_id"]
    return said.groupBy("conv_id").cogroup(heard.groupBy("conv_id")).applyInPandas(run, STRETCHES.format(kind=kind))


def alignment_accuracy(said: DataFrame, aligned: DataFrame) -> DataFrame:
    """conv_id, characters, aligned, correct, coverage, accuracy of each conversation: how much was heard, and how much of that with the right role."""
    size = F.col("end") - F.col("start")
    found = aligned.groupBy("conv_id").agg(F.sum(size).alias("aligned"), F.sum(F.when(F.col("role") == F.col("heard"), size).otherwise(0)).alias("correct"))
    total = said.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters")).join(found, "conv_id", "left").fillna(0, ["aligned", "correct"])
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return total.select("conv_id", "characters", "aligned", "correct", share("aligned", "characters").alias("coverage"), share("correct", "aligned").alias("accuracy"))


def mismatch_spans(aligned: DataFrame, least: int = 20) -> DataFrame:
    """conv_id, start, end, heard_start, characters, turns of spans heard with other roles: neighbouring stretches, ``least`` characters or more in all."""
    w = Window.partitionBy("conv_id").orderBy("start")
    wrong = aligned.filter(F.col("role") != F.col("heard"))
    goes_on = (F.lag("end").over(w) == F.col("start")) & (F.lag("heard_end").over(w) == F.col("heard_start"))
    spans = wrong.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    found = spans.groupBy("conv_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("heard_start").alias("heard_start"), F.count_distinct("turn").alias("turns"))
    return found.withColumn("characters", F.col("end") - F.col("start")).filter(F.col("characters") >= least).drop("span")


def upsert_sink(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch gives a new version of a table under ``path``; a batch that is run again gives the same one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch if number == 0 else merge(spark.read.parquet(f"{path}/version={number - 1}"), batch)
        out.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def refresher(build: Callable[[SparkSession], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch under a processing-time trigger, such as an hourly one: each time, what ``build`` gives is a new version."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch.sparkSession).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def put(store: DataFrame, new: DataFrame, key: str, ttl: float, at: float) -> DataFrame:
    """A store (key, value, expires) with new values (key, value), which live ``ttl`` seconds from ``at`` on; what has expired goes."""
    fresh = new.select(key, "value", F.lit(at + ttl).alias("expires"))
    return alive(store, at).join(fresh, key, "left_anti").unionByName(fresh)


def alive(store: DataFrame, at: float) -> DataFrame:
    return store.filter(F.col("expires") > F.lit(at))
