"""A training-corpus pipeline over the table documents: five stages, each written as a table and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, quality, secrets, sentencepiece_unigram, simhash_copies
from tessera.llm.common import scratch_path, table, unwrapped, wrapped


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws."""
    return quality.drawn(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash_copies.drop_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source to the target weights: a row for each time that the mix takes a document, at most
    three; one taken in part counts as taken. Documents that it doesn't take go."""
    rows = wrapped(docs).select("row", "row.doc_id", "row.text", "row.source")
    made, _ = mixing.mix(rows, F.array("source"))
    times = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    return unwrapped(made.where("mix_taken > 0").select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return sentencepiece_unigram.tokenize(docs.drop("n_chars"), sentencepiece_unigram.load(spark))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: The first stage fits a model and the last searches Viterbi paths, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_path(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
