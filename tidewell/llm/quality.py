"""A byte-level convolutional quality classifier, trained and applied with numpy inside Spark tasks.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters slide
over each chunk, and every filter's largest response in a chunk is kept. The mean and the maximum of these over all
chunks go through one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fold, named, read

#: Labelled rows, in expectation, that training sees; smaller sets are used whole.
FIT_ROWS = 4_000
#: Passes over them, and batches at least: small samples are passed over more often.
EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 6, 800, 32, 0.004, 11
CHUNK, HOP = 256, 192
DIM, WIDTH, STEP, FILTERS = 8, 8, 4, 16
WINDOWS = (CHUNK - WIDTH) // STEP + 1
#: Chunks that are convolved at once: bounds a task's memory whatever a text's length.
AT_ONCE = 2048
CUTOFF = 0.3

Weights = dict[str, np.ndarray]


def chunks(text: str | None) -> np.ndarray:
    """n x CHUNK bytes; consecutive rows share CHUNK - HOP bytes; the last one is padded with zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = 1 + max(0, -(-(len(data) - CHUNK) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (HOP, 1)).copy()


def windows(w: Weights, c: np.ndarray) -> np.ndarray:
    """n x WINDOWS x (WIDTH * DIM) inputs of the filters."""
    x = w["embed"][c].reshape(len(c), CHUNK * DIM)
    return np.lib.stride_tricks.as_strided(x, (len(c), WINDOWS, WIDTH * DIM), (x.strides[0], STEP * DIM * 4, 4))


def pooled(w: Weights, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each chunk, and where."""
    y = (np.ascontiguousarray(windows(w, c)).reshape(-1, WIDTH * DIM) @ w["filters"]).reshape(len(c), WINDOWS, FILTERS)
    at = y.argmax(axis=1)
    return np.tanh(np.take_along_axis(y, at[:, None, :], axis=1)[:, 0] + w["bias"]), at


def combine(w: Weights, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and combined features of texts whose chunks start at ``starts``."""
    sizes = np.diff(np.append(starts, len(h)))[:, None]
    features = np.concatenate([np.add.reduceat(h, starts) / sizes, np.maximum.reduceat(h, starts)], axis=1)
    return 1 / (1 + np.exp(-np.clip(features @ w["out"] + w["offset"], -30, 30))), features


def scores(w: Weights, texts: Sequence[str | None]) -> np.ndarray:
    out, held, size = [], [], 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(c) for c in held[:-1])])
        all_chunks = np.concatenate(held)
        h = np.concatenate([pooled(w, all_chunks[i : i + AT_ONCE])[0] for i in range(0, len(all_chunks), AT_ONCE)])
        out.append(combine(w, h, starts)[0])

    for text in texts:
        held.append(chunks(text))
        size += len(held[-1])
        if size >= AT_ONCE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: Sequence[str | None], labels: np.ndarray) -> Weights:
    """Adam on the logistic loss; the order of the rows and the seed determine the result."""
    rng = np.random.default_rng(SEED)
    w = {"embed": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, 2 * FILTERS), "offset": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    cut, step = [chunks(t) for t in texts], 0
    batches = max(1, len(cut) // BATCH)
    for _ in range(max(EPOCHS, -(-MIN_STEPS // batches)) if cut else 0):
        for rows in np.array_split(rng.permutation(len(cut)), batches):
            c = np.concatenate([cut[i] for i in rows])
            sizes = np.array([len(cut[i]) for i in rows])
            starts = np.cumsum(sizes) - sizes
            parts = [pooled(w, c[i : i + AT_ONCE]) for i in range(0, len(c), AT_ONCE)]
            h, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            p, features = combine(w, h, starts)
            error = ((p - labels[rows]) / len(rows)).astype(np.float32)
            doc = np.repeat(np.arange(len(rows)), sizes)
            largest = h == features[doc, FILTERS:]
            share = largest / np.maximum(np.add.reduceat(largest, starts, dtype=np.float32), 1)[doc]
            d_h = error[doc, None] * (w["out"][:FILTERS] / sizes[doc, None] + w["out"][FILTERS:] * share)
            d_y = (d_h * (1 - h**2)).astype(np.float32)
            grad = {"out": features.T @ error, "offset": error.sum(keepdims=True), "bias": d_y.sum(0), "filters": np.zeros_like(w["filters"]), "embed": np.zeros_like(w["embed"])}
            for f in range(FILTERS):  # only the window that won the pooling has a gradient
                seen = c[np.arange(len(c))[:, None], at[:, f, None] * STEP + np.arange(WIDTH)]
                grad["filters"][:, f] = d_y[:, f] @ w["embed"][seen].reshape(len(c), -1)
                back = d_y[:, f, None, None] * w["filters"][:, f].reshape(1, WIDTH, DIM)
                for d in range(DIM):
                    grad["embed"][:, d] += np.bincount(seen.ravel(), weights=back[:, :, d].ravel(), minlength=256)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


SHAPES = {"embed": (256, DIM), "filters": (WIDTH * DIM, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "offset": (1,)}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Weights:
    """Learn from about ``fit_rows`` usable labelled rows, drawn by a hash of the id; training is one task's work.

    Rows with a null label are left out; if there is none at all, the untrained weights score.
    """
    known = labels.filter(named(label_col).isNotNull()).select(named(id_col).alias("id"), named(label_col).cast("double").alias("label")).filter(F.col("id").isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.filter(usable).select(named(id_col).alias("id"), named(text_col).alias("text")).join(drawn, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "label", "text"])
        w = train(pdf["text"].tolist(), pdf["label"].to_numpy())
        return pd.DataFrame({"name": list(w), "value": [x.ravel().astype(float).tolist() for x in w.values()]})

    found = {r["name"]: r["value"] for r in rows.groupBy().applyInPandas(run, "name string, value array<double>").collect()}
    w = {k: np.array(v, dtype=np.float32).reshape(SHAPES[k]) for k, v in found.items()}
    return w or train([], np.zeros(0))


def score(docs: DataFrame, weights: Weights, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with ``score_col``, the probability of label 1; a column of docs of that name is replaced.

    A null text scores as the empty one, and repeated rows alike. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(shared.value, texts.tolist()))

    return docs.withColumn(score_col, run(named(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    weights = fit(docs, read(spark, sf_dir, "labels"), ~F.col("held_out"))
    return score(docs, weights).select("doc_id", "held_out", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
