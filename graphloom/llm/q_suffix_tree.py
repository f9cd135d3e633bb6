"""op4: scores of all documents, learnt from those whose crc32(doc_id) mod 7 is not 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, table
from graphloom.llm.suffix_tree import score_documents


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) == 2)


QUERIES = {"op4_suffix_tree": op4_suffix_tree}
ORACLE: dict[str, str] = {}
