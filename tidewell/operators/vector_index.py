"""A nearest-neighbour index: vectors dealt to cells around centroids, and searches of the cells near a query.

The centroids come from a few rounds of k-means over a bounded sample; every vector is indexed. A search scans the lists
of the ``probes`` cells nearest to each query. In exact mode it then scans those other cells whose vectors may still be
nearer than the k-th one found: for unit vectors the distance to a cell's centroid, less the cell's radius, bounds the
similarity to all of its members.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.relational import cut, shared_folder
from tidewell.operators.retrieval import unit

#: Vectors that the centroids are fitted on, chosen by a hash of the id. All vectors are indexed.
FIT_ROWS = 100_000
#: Most cells: their centroids go to every task.
MOST_CELLS = 4096
#: Vectors of a list that one task scans; a larger cell has several lists.
LIST_ROWS = 8192
#: Queries that meet a list in one task.
QUERY_ROWS = 1024
#: Vectors whose distances to all centroids are held at once.
ROWS_AT_ONCE = 256
#: Rows of a query and a cell that leave a task at once, each with the query's vector.
ROWS_OUT = 8192


@dataclass(frozen=True)
class Index:
    """``path`` holds (cell, part, id, vector at length 1) as a table partitioned by cell; ``cells`` has a cell's size, parts and radius."""

    path: str
    centroids: np.ndarray
    cells: pd.DataFrame
    id_type: str


def lists_of(index: Index, spark: SparkSession) -> DataFrame:
    return spark.read.schema(f"part int, id {index.id_type}, v array<double>, cell int").parquet(index.path)


def matrix(vectors: pa.Array | pd.Series, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else np.concatenate(vectors.to_list()) if len(vectors) else np.zeros(0)
    return flat.astype(np.float64).reshape(-1, width)


def nearest_cells(v: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n cells nearest to each row, nearest first; equal distances in the order of cells."""
    length = (centroids**2).sum(axis=1)[None, :]

    def part(v: np.ndarray) -> np.ndarray:
        d = length - 2 * (v @ centroids.T)
        return d.argmin(axis=1)[:, None] if n == 1 and d.shape[1] else np.argsort(d, axis=1, kind="stable")[:, :n]

    return np.concatenate([part(v[at : at + ROWS_AT_ONCE]) for at in range(0, max(1, len(v)), ROWS_AT_ONCE)])


def fit_centroids(sample: DataFrame, cells: int, rounds: int, width: int) -> np.ndarray:
    """Rounds of k-means: each task sums its vectors by nearest centroid, and only cells x width numbers come back."""
    spark = sample.sparkSession
    centroids = np.array([r["v"] for r in sample.orderBy(F.xxhash64("id"), "id").limit(cells).collect()], dtype=np.float64).reshape(-1, width)
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(sent.value), np.zeros(len(sent.value), dtype=np.int64)
            for batch in batches:
                v = matrix(batch.column("v"), width)
                at = nearest_cells(v, sent.value)[:, 0] if len(v) else np.zeros(0, dtype=np.int64)
                np.add.at(total, at, v)
                count += np.bincount(at, minlength=len(count))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "n", "s"])

        parts = sample.select("v").mapInArrow(sums, "cell int, n long, s array<double>")
        total = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(width))).alias("s")).collect()
        for r in total:  # a cell without vectors keeps its centroid
            centroids[r["cell"]] = np.array(r["s"]) / r["n"]
        sent.unpersist()
    return centroids


def build(df: DataFrame, id_col: str, vector_col: str, cells: int | None = None, rounds: int = 5, path: str | None = None) -> Index:
    """An index over all rows of df, written as a table in the session's shared folder, or to ``path``.

    Vectors have one width; null vectors and such with a null or a number that is not finite are not indexed. A vector of
    zeros is similar to none (0). By default there are about sqrt(n) cells.
    """
    fit = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(fit).select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v"))
    n, width = df.filter(fit).agg(F.count("*"), F.coalesce(F.max(F.size(vector_col)), F.lit(1))).first()
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS)
    share = min(1.0, FIT_ROWS / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    centroids = fit_centroids(sample, cells, rounds, width)
    path = path or f"{shared_folder(df.sparkSession)}/cells-{uuid.uuid4().hex}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            at = nearest_cells(v, centroids)[:, 0] if len(v) else np.zeros(0, dtype=np.int64)
            far = np.sqrt(((v - centroids[at]) ** 2).sum(axis=1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    kind = dict(rows.dtypes)["id"]
    dealt = rows.mapInArrow(deal, f"id {kind}, v array<double>, cell int, far double")
    at = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas().sort_values("cell")  # a row for each cell
    at["parts"] = -(-at["n"] // LIST_ROWS)
    parts = F.create_map(*(F.lit(int(x)) for r in at[at["parts"] > 1].itertuples() for x in (r.cell, r.parts))) if (at["parts"] > 1).any() else None
    part = F.pmod(F.xxhash64("id", "v"), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int") if parts is not None else F.lit(0)
    dealt.select("cell", part.alias("part"), "id", "v").repartition("cell", "part").sortWithinPartitions("cell", "part", "id").write.partitionBy("cell").parquet(path)
    return Index(path, centroids, at, kind)


def scan(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query, doc, score: for each asked (query, qv, cell) the k best of each list of the cell.

    A list meets the queries of its cell in blocks, which are counted first: neither side of a task grows with the table.
    """
    spark, kind = asked.sparkSession, index.id_type
    asked = cut(asked)
    n = asked.groupBy("cell").agg(F.count("*").alias("asked")).toPandas()  # a row for each cell
    plan = index.cells[["cell", "parts"]].merge(n, on="cell")
    plan["blocks"] = -(-plan["asked"] // QUERY_ROWS)
    plan = F.broadcast(spark.createDataFrame(plan[["cell", "parts", "blocks"]].astype("int32"), "cell int, parts int, blocks int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(plan, "cell").select("query", "qv", "cell", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), each("parts").alias("part"))
    lists = lists_of(index, spark).join(plan, "cell").select("cell", "part", "id", "v", each("blocks").alias("block"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        ids = b["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.stack(b["v"].to_list())[order] if len(b) and len(a) else None
        for at in range(0, len(a) if len(b) else 0, 128):
            part = a.iloc[at : at + 128]
            own = part["query"].to_numpy()
            score = np.stack(part["qv"].to_list()) @ v.T
            score[own[:, None] == ids[order][None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out = pd.DataFrame({"query": np.repeat(own, best.shape[1]), "doc": ids[order][best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()})
            found.append(out[out["score"] > -np.inf])
        return pd.concat(found) if found else pd.DataFrame({"query": [], "doc": [], "score": []})

    return left.groupBy("cell", "part", "block").cogroup(lists.groupBy("cell", "part", "block")).applyInPandas(run, f"query {kind}, doc {kind}, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def asked_cells(index: Index, queries: DataFrame, choose) -> DataFrame:
    """A row for each query and cell that ``choose`` (unit vectors, extra column) gives."""
    centroids, kind = index.centroids, index.id_type
    extra = "least" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            v = matrix(batch.column("qv"), centroids.shape[1]) if len(centroids) else np.zeros((0, 1))
            least = batch.column("least").to_numpy(zero_copy_only=False) if extra else None
            rows, cells = choose(v, least) if len(v) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
            for at in range(0, len(rows), ROWS_OUT):
                some = pa.array(rows[at : at + ROWS_OUT])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(some), batch.column("qv").take(some), pa.array(cells[at : at + ROWS_OUT].astype(np.int32))], names=["query", "qv", "cell"])

    return queries.mapInArrow(run, f"query {kind}, qv array<double>, cell int")


def search(index: Index, queries: DataFrame, k: int, id_col: str, vector_col: str, probes: int = 8, exact: bool = False) -> DataFrame:
    """query, doc, score, rank: the k most similar vectors of the index for each query, its own id left out.

    ``queries`` have unique ids. With ``exact`` the result is that of a scan of all vectors, whatever ``probes`` is.
    """
    centroids, cells = index.centroids, index.cells
    asking = queries.select(F.col(id_col).alias("query"), unit(F.col(vector_col)).alias("qv"))

    def near(v: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        at = nearest_cells(v, centroids, probes)
        return np.repeat(np.arange(len(v)), at.shape[1]), at.ravel()

    first = best_of(scan(index, asked_cells(index, asking, near), k), k)
    if not exact:
        return first.select("query", "doc", "score", "rank")

    radius = np.full(len(centroids), -np.inf)
    radius[cells["cell"].to_numpy()] = cells["radius"].to_numpy()

    def rest(v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells behind the probed ones whose vectors may be as similar as the k-th."""
        far = np.sqrt(np.maximum(0.0, (v**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2 * (v @ centroids.T)))
        may = 1 - np.maximum(0.0, far - radius[None, :]) ** 2 / 2 >= least[:, None] - 1e-9
        np.put_along_axis(may, nearest_cells(v, centroids, probes), False, axis=1)
        return np.nonzero(may & (radius >= 0)[None, :])

    first = cut(first.select("query", "doc", "score"))
    least = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("query").alias("of"), F.when(F.col("n") >= k, F.col("s")).alias("s"))
    again = asking.join(least, F.col("query") == F.col("of"), "left").select("query", "qv", F.coalesce("s", F.lit(-2.0)).alias("least"))
    more = scan(index, asked_cells(index, again, rest), k)
    return best_of(first.unionByName(more), k).select("query", "doc", "score", "rank")


def probes_for(index: Index, queries: DataFrame, k: int, id_col: str, vector_col: str, least: float = 0.95) -> int:
    """The least number of probes that finds ``least`` of the k nearest vectors of some queries, in the mean.

    A neighbour is found if its cell is among those probed; so an exact search tells for each the place of its cell
    among its query's nearest ones, and only how often each place is there comes back.
    """
    centroids = index.centroids
    exact = search(index, queries, k, id_col, vector_col, exact=True).select("query", F.col("doc").alias("id"))
    asking = queries.select(F.col(id_col).alias("query"), unit(F.col(vector_col)).alias("qv"))
    met = exact.join(lists_of(index, queries.sparkSession).select("id", "cell"), "id").join(asking, "query").select("qv", "cell")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            v = matrix(batch.column("qv"), centroids.shape[1]) if len(centroids) else np.zeros((0, 1))
            at = np.argsort(nearest_cells(v, centroids, len(centroids)), axis=1)[np.arange(len(v)), batch.column("cell").to_numpy()] if len(v) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32())], names=["place"])

    counts = met.mapInArrow(place, "place int").groupBy("place").count().toPandas().sort_values("place")  # a row for each cell at most
    if not len(counts):
        return 1
    share = counts["count"].cumsum() / counts["count"].sum()
    return int(counts["place"][share >= least].iloc[0]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query, recall: the share of a query's exact neighbours that were found."""
    hits = exact.select("query", "doc").join(found.select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return hits.groupBy("query").agg((F.count("hit") / F.count("*")).alias("recall"))

