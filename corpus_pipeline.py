"""Training-data pipeline: quality, line dedup, near-duplicate removal, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import bpe, line_dedup, mixing, ngram_join, quality
from loanlens.llm.shared import materialize, ship


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` with the columns of ``docs`` in order; n_chars follows the text."""
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts.select(*[f"`{c}`" for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps, unchanged."""
    ship(spark)
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines."""
    ship(spark)
    return _with_text(docs, line_dedup.line_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (null ones last).

    Five-word shingles, similarity 0.8.  Every row is a document of its own, so of rows that
    repeat a doc_id or have none, and are alike, one stays too.  Rows without words are in no
    group and stay.
    """
    ship(spark)
    columns = docs.columns
    own = materialize(docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("row", F.monotonically_increasing_id()))
    key, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    groups = ngram_join.join(own.select("row", text.alias("text")), "row").join(own.select("row", key.alias("key")), "row")
    # of groups with several rows only; minima are combined before the shuffle
    first = groups.groupBy("component_id").agg(F.count("*").alias("c"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")).where("c > 1")
    gone = materialize(groups.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("row"))
    return own.join(gone, "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and epoch in which the schedule takes words of it.

    A document read twice stands there twice; documents that the mix doesn't take, or that have
    no words, go.
    """
    ship(spark)
    return _with_text(docs, mixing.mixed(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each row."""
    ship(spark)
    return bpe.bpe(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifier, the hash order of the mix and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
