"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what it returns as
Parquet into the shared folder and reads it as the next stage's documents.  All
stages but the last keep the columns of their input, in order, also such as have
names that the operators add.

Null and empty texts are scored by the classifier like any other; a text without
a word that it accepts, and one that line dedup leaves without a word, goes in the
second stage.  Rows that repeat id and text are scored alike, keep their lines
together, and stay or go together; of other ties (copies, similar texts) the
smallest id stays, then the smallest hash of the text.  Rows with a null id take
part in every stage.  Very long texts are read as a whole.  Empty tables give no
rows; without labels the classifier knows nothing and accepts none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.llm import bpe, decontam, fm_quality, line_dedup, simhash
from wayloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = fm_quality.predictions(docs, labels, out="__score", predicted="__predicted")
    return scored.where("__predicted = 1").drop("__score", "__predicted")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; ``n_chars`` follows the text.  Those left without a word go."""
    out = line_dedup.dedup_lines(docs, counts=("__lines", "__deleted")).drop("__lines", "__deleted")
    out = out.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word five-grams have a similarity of 0.8, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text, counted, and digests of them and of the text decoded from them."""
    return bpe.digests(docs.select("doc_id", "text"), bpe.vocabulary_path()).drop("text")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe", tokens),
]

#: The classifier is trained and the links are followed in rounds, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
