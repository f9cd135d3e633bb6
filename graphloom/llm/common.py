"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only where that is unset and both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors. tidy: the shuffle files of
    a table are deleted once it is written, not when the driver next collects garbage."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.base, self.tidy = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", tidy

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy and before is None:
                self.spark.conf.unset(_CLEANUP)
            elif self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later result reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(column: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text: bits are shifted out one by one, eight a byte."""
    one = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {one})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda z: ord(z)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blobs(column: pa.Array) -> list[bytes]:
    """A binary or string column as bytes; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans: maximal runs; spans that touch become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > reach[:-1]
    last = np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)
    return lo[first], reach[last]


def heavy_keys(counts: DataFrame, keys: list[str], part: int = 2048, most: int = 10_000) -> DataFrame:
    """Of counts (keys, n) the keys of over `part` rows, with `salts`, the number of parts to deal them out to; never more
    than the `most` largest, so that they can be broadcast."""
    large = counts.where(F.col("n") > part).orderBy(F.desc("n"), *keys).limit(most)
    return large.select(*keys, F.ceil(F.col("n") / part).cast("int").alias("salts"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """many joined with few, the rows of heavy keys dealt out by the hash `by` of a row and met by as many copies of
    `few`'s rows: no row is lost, only the way it takes is another."""
    heavy = F.broadcast(heavy)  # at most `most` rows, see heavy_keys()
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(by, F.col("salts"))).cast("int")
    dealt = many.join(heavy, keys, "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    met = few.join(heavy, keys, "left").withColumn("salt", copies).drop("salts")
    return dealt.join(met, [*keys, "salt"], how).drop("salt")
