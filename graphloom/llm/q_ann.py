"""op1: the 5 nearest vectors of each whose vec_id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.ann import nearest
from graphloom.llm.common import table


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {"op1_collision_counting": op1_collision_counting}
ORACLE: dict[str, str] = {}
