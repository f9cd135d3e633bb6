"""op5: language of every document, learnt from those whose crc32(doc_id) mod 5 is not 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, table
from graphloom.llm.langid import identify


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 5) == 0)


QUERIES = {"op5_byte_cnn": op5_byte_cnn}
ORACLE: dict[str, str] = {}
