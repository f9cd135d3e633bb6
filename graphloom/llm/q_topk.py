"""op9: the 10 nearest sign codes of each vector whose vec_id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.topk import nearest_codes, sign_code


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_codes(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=10, code=sign_code())


QUERIES = {"op9_multi_index": op9_multi_index}
ORACLE = {
    "op9_multi_index": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] <> v.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v AS q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10"""
}
