"""op6: which documents are fit for training; those whose crc32(doc_id) mod 5 is 0 teach nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, table
from graphloom.llm.quality import classify


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=crc_bucket(F.col("doc_id"), 5) == 0)


QUERIES = {"op6_weak_labels": op6_weak_labels}
ORACLE: dict[str, str] = {}
