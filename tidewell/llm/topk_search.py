"""Exact top-k search by integer inner product: term-at-a-time accumulation over blocks.

Rows are sparse: terms with integer weights. Queries and rows are dealt to blocks by a hash, and every block of queries
meets every block of rows in one task. There the rows become postings (for each term the rows that hold it), each term
of a query scatters its weighted postings into a dense array of scores, and a partition selects the best of each query.
A window over what the blocks selected, k rows and one from each, merges them.

The work is queries times rows, as an exhaustive search's is; a task holds one block of each side, whatever the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import named, partitions, read, stored

#: Queries, and rows, that a block is planned to hold.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Small tables are dealt to more blocks than ROW_BLOCK asks for, one for each task, while those have so many rows.
LEAST_ROWS = 1024
#: Scores that are accumulated at a time: as many as stay in a processor's cache.
CELLS = 1 << 17
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def arrays(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the values of a list column."""
    column = pa.concat_arrays(table[name].chunks)
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def kind_for(*tables: pa.Table) -> type:
    """The narrowest type that holds every score between the tables' rows; Python's integers where 64 bits do not."""
    bound = 1
    for t in tables:
        lengths, weights = arrays(t, "weights")
        bound *= max(1, int(lengths.max(initial=0)) * max(int(weights.max(initial=0)), -int(weights.min(initial=0))))
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


class Postings:
    """For each term the rows with it, in their order, and the weights; a term that a row repeats counts once, with the sum."""

    def __init__(self, table: pa.Table, kind: type) -> None:
        lengths, terms = arrays(table, "terms")
        weights = arrays(table, "weights")[1].astype(kind)
        rows = np.repeat(np.arange(len(table)), lengths)
        order = np.lexsort((rows, terms))
        rows, terms, weights = rows[order], terms[order], weights[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else np.zeros(0, dtype=np.int64)
        if len(first) < len(rows):
            weights = np.add.reduceat(weights, first)
            rows, terms = rows[first], terms[first]
        self.rows, self.weights, self.n = rows, weights, len(table)
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts, len(rows))[1:]

    def of(self, term) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return self.rows[:0], self.weights[:0]
        return self.rows[self.starts[at] : self.ends[at]], self.weights[self.starts[at] : self.ends[at]]


def accumulated(queries: Postings, docs: Postings, kind: type) -> np.ndarray:
    """Scores of each query (row) and document (column), term at a time."""
    scores = np.zeros((queries.n, docs.n), dtype=kind)
    for term, a, b in zip(queries.terms, queries.starts, queries.ends, strict=True):
        rows, weights = docs.of(term)
        if len(rows):
            part = np.multiply.outer(queries.weights[a:b], weights)
            if len(rows) < docs.n:
                scores[np.ix_(queries.rows[a:b], rows)] += part
            elif b - a < queries.n:
                scores[queries.rows[a:b]] += part
            else:
                scores += part
    return scores if kind is not object else np.clip(scores, LEAST, MOST)


def selected(scores: np.ndarray, copies: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, equal ones by place; a place is there as often as its row."""
    k = min(most, len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    found = np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]
    found = np.repeat(found, copies[found])
    return found[np.lexsort((found, ~scores[found]))][:most]  # ~: the order turned round, without overflow


def block_search(k: int, schema: pa.Schema):
    """The best k + 1 rows of a block for each query of a block: one of them may be the query's own."""

    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        if not len(queries) or not len(docs):
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs["id"], null_placement="at_end"))
        kind = kind_for(queries, docs)
        postings, copies = Postings(docs, kind), np.minimum(docs["copies"].to_numpy(), k + 1)
        asked, found, score, own = [], [], [], []
        step = max(1, CELLS // len(docs))
        for at in range(0, len(queries), step):
            part = queries.slice(at, step)
            mine = Postings(part, kind)
            scores = accumulated(mine, postings, kind)
            square = np.zeros(len(part), dtype=object)
            np.add.at(square, mine.rows, mine.weights.astype(object) ** 2)
            for i, row in enumerate(scores):
                best = selected(row, copies, k + 1)
                asked += [at + i] * len(best)
                found.append(best)
                score.append(row[best].astype(np.int64))
                own += [min(square[i], MOST)] * len(best)
        left = queries.select(["query", "key", "times"]).take(pa.array(asked, pa.int64()))
        out = left.append_column("own", pa.array(own, pa.int64())).append_column("id", docs["id"].take(pa.array(np.concatenate(found))))
        return out.append_column("score", pa.array(np.concatenate(score))).cast(schema)

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", terms_col: str = "terms", weights_col: str = "weights", own: bool = True) -> DataFrame:
    """query_id, rank, id, score: the k rows of the highest inner product with each query, equal ones by the smaller id.

    Both tables have an id, an array of integer terms and one of integer weights (bigint), as long. With ``own``, queries
    are rows of ``rows``, and a query's own row is not among its results. A row whose arrays are null, hold a null or
    differ in length takes no part; one without terms scores 0 with all. Rows that repeat an id are rows like others: each
    is found, and each that is a query has its results. Null ids come last of equal scores. Scores beyond a bigint count
    as its ends. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession

    def distinct(df: DataFrame) -> DataFrame:
        terms, weights = (named(c).cast("array<bigint>") for c in (terms_col, weights_col))
        whole = (F.size("terms") == F.size("weights")) & ~F.exists("terms", F.isnull) & ~F.exists("weights", F.isnull)
        return df.select(named(id_col).alias("id"), terms.alias("terms"), weights.alias("weights")).filter(whole).groupBy("id", "terms", "weights").agg(F.count("*").alias("copies"))

    docs, asking = stored(distinct(rows)), stored(distinct(queries))
    if not (n := asking.count()):
        n = 1
    m = docs.count()
    i, j = -(-n // QUERY_BLOCK), max(1, -(-m // ROW_BLOCK), min(partitions(spark), m // LEAST_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("id", "terms", "weights"), F.lit(count)).cast("int")
    left = asking.select(F.col("id").alias("query"), F.xxhash64("terms", "weights").alias("key"), F.col("copies").alias("times"), "terms", "weights", block(i).alias("i"), every(j).alias("j"))
    right = docs.select("id", "copies", "terms", "weights", every(i).alias("i"), block(j).alias("j"))

    kind = dict(docs.dtypes)["id"]
    ids = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    schema = pa.schema([("query", ids), ("key", pa.int64()), ("times", pa.int64()), ("own", pa.int64()), ("id", ids), ("score", pa.int64())])
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(block_search(k, schema), f"query {kind}, key long, times long, own long, id {kind}, score long")

    query = Window.partitionBy("query", "key")
    best = found.withColumn("r", F.row_number().over(query.orderBy(F.desc("score"), F.col("id").asc_nulls_last()))).filter(F.col("r") <= k + 1)
    itself = F.min(F.when(F.col("id").eqNullSafe(F.col("query")) & (F.col("score") == F.col("own")), F.col("r"))).over(query) if own else F.lit(None).cast("int")
    best = best.withColumn("at", F.coalesce(itself, F.lit(k + 2))).filter(F.col("r") != F.col("at"))
    best = best.select("query", (F.col("r") - F.when(F.col("at") < F.col("r"), 1).otherwise(0)).alias("rank"), "id", "score", "times").filter(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("time")


def sparse(vector: Column, scale: int = 256) -> tuple[Column, Column]:
    """Terms and weights of a vector: the places, and floor(scale * x) of each component in doubles, where that is not 0.

    Null if the vector is null or has a component that is null or not finite.
    """
    bad = F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    cells = F.filter(F.transform(vector, lambda x, i: F.struct(i.cast("bigint").alias("term"), F.floor(x.cast("double") * scale).cast("bigint").alias("weight"))), lambda c: c["weight"] != 0)
    cells = F.when(~bad, cells)
    return cells.getField("term"), cells.getField("weight")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, weights = sparse(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), terms.alias("terms"), weights.alias("weights"))
    return top_k(rows.filter("id % 50 = 0"), rows, 5).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM e q JOIN e d ON q.n <> d.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY n ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
