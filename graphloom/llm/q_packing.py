"""op7: all documents in sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table
from graphloom.llm.packing import pack_digests

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_digests(table(spark, sf_dir, "documents"), FILES, 2048)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_best_fit": op7_best_fit}
ORACLE: dict[str, str] = {}
