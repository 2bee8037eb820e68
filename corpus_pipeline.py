"""A corpus pipeline over ``documents``: known languages, one document of each near-duplicate group, secrets out, sources mixed, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next one.  All but the last return the columns of
documents, whatever further columns these are, and work on texts of any length, null
ones included; an empty table passes all stages.  A table is deleted once its successor is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm import language_id, mixing, ngram_join, secret_scan, sentencepiece_codec, shared


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with confidence; ``lang`` becomes what was found.

    Null and empty texts, and those without a letter, are rejected; equal rows have one verdict.
    """
    return language_id.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest doc_id (a null one last), and of rows equal in id and text one.

    A text without words is linked with nothing.
    """
    row, key = F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key")
    groups = ngram_join.linked(docs.select(key.alias("doc_id"), "text"))
    ids = docs.select(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("place"))
    named = groups.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = named.groupBy("component_id").agg(F.min(F.struct("place", "key")).alias("least")).select(F.col("least.key").alias("key"))
    kept = docs.select(key, row).join(first, "key", "left_semi")
    return kept.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars`` follows the text.  No row goes; a null text stays null."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, perhaps not at all; the null source is a source, of equal sizes the smaller id comes first."""
    return mixing.repeated(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids; a null text has null pieces."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed_sources),
    ("sentencepiece", pieces),
]

#: Language models and forests are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, shared.written(stage(spark, docs, sf_dir), name)
        shared.drop(before)
    return docs
