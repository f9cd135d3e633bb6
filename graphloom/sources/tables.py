"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str = "parquet", tidy: bool = False, **options) -> DataFrame:
    """The rows written and read again: lineage is cut, and columns made from the partitioning no longer change. tidy: the
    table's shuffle files are deleted once it is written, not when the driver next collects garbage."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).format(kind).save(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_CLEANUP)
        elif tidy:
            spark.conf.set(_CLEANUP, before)
    return spark.read.options(**options).schema(df.schema).format(kind).load(path)
