"""The corpus pipeline: five stages over ``documents``, each calling one training-data operator.

A stage takes (spark, docs, sf_dir) and gets all that the one before it kept; ``run`` writes each stage's result as
Parquet to the session's shared folder and reads it again as the next one's docs.

In every stage a null text counts as the empty one, each row is decided on by its own text and id, whether or not the id
is null or repeated, and a table without rows gives one without rows. Columns beside those of ``documents`` are left
behind: each stage returns the columns in COLUMNS, and the last one its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, line_dedup, near_dedup, quality, sentencepiece_codec
from tidewell.llm.common import bounded_batches, cut, read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on all labels, takes for low quality.

    A null text scores as the empty one; equal texts score alike, so that repeated rows stay or go together. Long texts
    are scored whole. Labels without a document, and null labels, teach nothing; without any the untrained weights score.
    """
    bounded_batches(spark)
    weights = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, weights, score_col="quality score").filter(F.col("quality score") >= quality.CUTOFF).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of texts and drop documents of which nothing but white space is left by that.

    The earliest of equal lines stays, by id (null ids last), then line number; texts that share an id come in the order
    of a hash, and rows that repeat both id and text are one text and stay alike. Documents that lose no line stay as
    they are, empty and null texts too. n_chars is counted anew where a line has gone.
    """
    bounded_batches(spark)
    out = line_dedup.deduplicate_lines(docs)
    return out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs less the texts in gone (doc_id, text hash), or with left_semi only those; a null id is an id like others."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text hash").alias("gone_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), how)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The one of the least id stays, null ids last; of texts that share an id the one of the least hash, and of rows that
    repeat both id and text one. Documents without words all stay.
    """
    bounded_batches(spark)
    found = cut(near_dedup.near_duplicates(docs, text_key="text hash").filter("n_shingles > 0").groupBy("doc_id", "text hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")))
    kept, repeated = without(docs, found.filter("not kept")), found.filter("kept AND n > 1")
    if not repeated.isEmpty():
        once = without(kept, repeated, "left_semi").withColumn("text hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text hash"])
        kept = without(kept, repeated).select(*COLUMNS).unionByName(once.select(*COLUMNS))
    return kept.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark contaminates, each by its own text, whether or not its id is null or repeated."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), text_key="text hash")
    return without(docs, found.filter("contaminated")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, with a check that they decode to it.

    A null text has null ids and no pieces, an empty one no pieces; both decode to themselves. Repeated rows give a row
    each, and a very long text goes through in parts. Nothing is dropped.
    """
    bounded_batches(spark)
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

#: The classifier and the tokeniser have no SQL: tests hold each stage, and the run, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
