"""A training-data pipeline over `documents`: each stage works on what the one before it kept.

Stages take and return the columns of documents; other columns are dropped. Null and empty texts are rejected by the
first stage; an empty table stays empty through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch
from graphloom.llm.mixing import mix
from graphloom.llm.packing import pack_documents
from graphloom.llm.quality import classify
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.suffix import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=COLUMNS)
    return found.where("keep").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays; of
    several rows with that id the one whose text, then language, source and length, comes first. Documents without an
    id stay as they are."""
    found = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct("text", "lang", "source", "n_chars")
    kept = docs.join(found, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more, which 51 words of prose exceed, that also stand elsewhere go from the texts; texts left
    empty go."""
    found = dedup_substrings(docs, length=200, carry=tuple(COLUMNS), as_text=True)
    return found.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).where("n_chars > 0").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words, drawn to the target weights of source, language and topic."""
    return mix(docs.select(COLUMNS), budget=0.9).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return pack_documents(docs, FILES, 2048).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]
#: Fingerprints, the classifier and the suffix order can't be said in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's result written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
