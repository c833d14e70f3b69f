"""The corpus pipeline: documents through stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmart.llm import exact_dedup, langid, mixing, near_dedup, pieces
from sparkmart.session import scratch_path, tune

# From four fifths on; a pair just there misses all 30 bands of 5 rows with a probability of 7e-6.
NEAR = near_dedup.Settings(percent=80, bands=30, rows=5, margin=0.19)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents of no known language go, missing labels are filled."""
    return langid.in_known_language(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact de-duplication: of equal texts the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-de-duplication: of documents linked with each other the one with the smallest id stays."""
    return near_dedup.keep_one(docs, settings=NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time a document is taken, its text cut where only a part is."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: the ids of every row's text."""
    encoded = pieces.encode(docs, pieces.Vocabulary.load())
    return encoded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixed),
    ("sentencepiece", tokens),
]

# A trained network, MinHash buckets and tokens are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
