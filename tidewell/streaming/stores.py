"""Stores with expiry as keyed state: values that live for a time, and a semantic cache of answers.

Both are stateful processors with timers of event time, so that what a stream gives does not depend on when its batches
run: a value is gone once an event is later than its end, and the state of a key goes when the watermark has passed
that. Streams that use them need the RocksDB state store (``use_state_store``). Their table forms go through each key's
rows in order with the same steps.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.streaming.conversations import in_order

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


# Values with an end.

STORE_ROWS = "key string, id long, op string, value string"


class Value:
    """One key's value: None or (value, end in seconds)."""

    def __init__(self, held: tuple[str | None, float] | None = None) -> None:
        self.held = held

    def apply(self, op: str, value: str | None, at: float, ttl: float) -> str | None:
        """What the key holds after an operation: put, delete, or get (any other word), which changes nothing."""
        if self.held and at >= self.held[1]:
            self.held = None
        if op == "put":
            self.held = (value, at + ttl)
        elif op == "delete":
            self.held = None
        return self.held[0] if self.held else None


def applied(value: Value, key: str | None, rows: pd.DataFrame, ttl: float) -> pd.DataFrame:
    rows = rows.sort_values(["at", "id"])
    out = [(key, r.id, r.op, value.apply(r.op, None if pd.isna(r.value) else r.value, r.at, ttl)) for r in rows.itertuples()]
    return pd.DataFrame(out, columns=["key", "id", "op", "value"])


class Store(StatefulProcessor):
    """Values by key with an end; a timer at the end clears the key and says so."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", "value string, ends double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        value = Value(held)
        for frame in rows:
            yield applied(value, key[0], frame, self.ttl)
        if value.held == held:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if value.held:
            self.state.update(value.held)
            self.handle.registerTimer(int(value.held[1] * 1000))
        else:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([(key[0], None, "expired", None)], columns=["key", "id", "op", "value"]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def store_stream(df: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """(key, id, ts, op, value) of a stream: what each key holds after each operation, and ``expired`` where one has ended.

    Operations of a key that are in one batch are taken in order of ts and id.
    """
    rows = df.withWatermark("ts", late).withColumn("at", seconds("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Store(ttl), outputStructType=STORE_ROWS, outputMode="Append", timeMode="EventTime")


def store_table(df: DataFrame, ttl: float) -> DataFrame:
    """The same over a table, without rows for ends."""

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        value = Value(state.get if state.exists else None)
        for frame in frames:
            yield applied(value, key[0], frame, ttl)
        state.update(value.held)

    rows = df.select("key", "id", seconds("ts").alias("at"), "op", "value")
    return in_order(rows, "key", ["at", "id"], step, STORE_ROWS)


# The semantic cache.

CACHE_ROWS = "cache string, id long, outcome string, answer string, score double"


class Cache:
    """Answers by exact text, with their vectors; in order of age."""

    def __init__(self, ttl: float, most: int, least: float) -> None:
        self.ttl, self.most, self.least = ttl, most, least
        self.entries: OrderedDict[str, tuple[float, np.ndarray, str]] = OrderedDict()

    def prune(self, at: float) -> None:
        for key in [k for k, (then, _, _) in self.entries.items() if at - then > self.ttl]:
            del self.entries[key]
        while len(self.entries) > self.most:
            del self.entries[min(self.entries, key=lambda k: self.entries[k][0])]

    def ask(self, text: str, vector, answer: str, at: float) -> tuple[str, str | None, float]:
        """(outcome, answer, score): the answer of the same text, or of the most similar vector of ``least`` or more.

        A miss is answered from outside and kept. Of equally similar ones the older counts; a vector of no length is
        similar to none.
        """
        self.prune(at)
        text = text.strip().lower()
        if text in self.entries:
            return "exact", self.entries[text][2], 1.0
        v = np.asarray(vector, dtype=np.float64)
        best, found = 0.0, None
        for _, other, known in self.entries.values():
            lengths = float(np.sqrt(v @ v) * np.sqrt(other @ other))
            score = float(v @ other) / lengths if lengths else 0.0
            if score >= self.least and score > best:
                best, found = score, known
        if found is not None:
            return "similar", found, best
        self.entries[text] = (at, v, answer)
        return "miss", answer, 0.0


def answered(cache: Cache, name, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["at", "id"])
    return pd.DataFrame([(name, r.id, *cache.ask(r.text or "", r.vector, r.answer, r.at)) for r in rows.itertuples()], columns=["cache", "id", "outcome", "answer", "score"])


class SemanticCache(StatefulProcessor):
    """A cache's entries as map state; a timer clears a cache that nothing has been put into for its time to live."""

    def __init__(self, ttl: float, most: int, least: float) -> None:
        self.ttl, self.most, self.least = ttl, most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("entries", "text string", "at double, vector array<double>, answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cache = Cache(self.ttl, self.most, self.least)
        held = {k[0]: tuple(v) for k, v in self.state.iterator()}
        for text, (at, vector, answer) in sorted(held.items(), key=lambda x: x[1][0]):
            cache.entries[text] = (at, np.asarray(vector, dtype=np.float64), answer)
        for frame in rows:
            yield answered(cache, key[0], frame)
        for text in set(held) - set(cache.entries):
            self.state.removeKey((text,))
        for text, (at, vector, answer) in cache.entries.items():
            if text not in held or held[text][0] != at:
                self.state.updateValue((text,), (at, vector.tolist(), answer))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if cache.entries:
            self.handle.registerTimer(int((max(at for at, _, _ in cache.entries.values()) + self.ttl) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(df: DataFrame, ttl: float = 300.0, most: int = 200, least: float = 0.85, late: str = "0 seconds") -> DataFrame:
    """(cache, id, ts, text, vector, answer) of a stream of questions, each with the answer that it would get from outside:
    what the cache gives for it. A cache keeps ``most`` entries, for ``ttl`` seconds; it is one task's, whose state that bounds.
    """
    rows = df.withWatermark("ts", late).withColumn("at", seconds("ts"))
    return rows.groupBy("cache").transformWithStateInPandas(SemanticCache(ttl, most, least), outputStructType=CACHE_ROWS, outputMode="Append", timeMode="EventTime")


def cache_table(df: DataFrame, ttl: float = 300.0, most: int = 200, least: float = 0.85) -> DataFrame:
    """The same over a table."""

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        cache = state.get if state.exists else Cache(ttl, most, least)
        for frame in frames:
            yield answered(cache, key[0], frame)
        state.update(cache)

    rows = df.select("cache", "id", seconds("ts").alias("at"), "text", F.col("vector").cast("array<double>").alias("vector"), "answer")
    return in_order(rows, "cache", ["at", "id"], step, CACHE_ROWS)
