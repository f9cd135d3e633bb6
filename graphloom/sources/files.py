"""Files as rows: inventories, manifests, checks. Contents stay on the executors."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rules

#: First folder name that matches gives a file its category.
CATEGORIES = (("raw", "raw"), ("processed", "processed"), ("review", "review"), ("training", "training"), ("models", "model"), ("examples", "examples"), ("corpus", "corpus_report"), ("graph", "graph_report"), ("wireframes", "wireframe"), ("reports", "report"))


def listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """path, name, suffix, bytes of all files below a folder; with their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select("path", name.alias("name"), suffix.alias("suffix"), F.col("length").alias("bytes"), *(["content"] if content else []))


def corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 (upper case), lines, records (JSON lines: not blank ones; CSV and TSV: one less; else 0)."""
    hashed = listing(spark, path, content=True).select("path", "suffix", "bytes", F.upper(F.sha2("content", 256)).alias("sha256"))
    text = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = text.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.trim("value") != "").alias("filled"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    met = hashed.withColumn("path", plain("path")).join(lines.withColumn("path", plain("path")), "path", "left").fillna(0, ["lines", "filled"])
    records = F.when(F.col("suffix") == ".jsonl", F.col("filled")).when(F.col("suffix").isin(".csv", ".tsv"), F.greatest(F.lit(0), F.col("filled") - 1)).otherwise(0)
    return met.select("path", "bytes", "sha256", "lines", records.alias("records"))


def category(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    out = F
    for part, name in CATEGORIES:
        out = out.when(F.array_contains(parts, part), name)
    return out.otherwise("other")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path).withColumn("category", category(F.col("path")))


def search(files: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """Files with the text, of any case, in path or category; exact: equal to path or name."""
    t = text.lower()
    if exact:
        return files.where((F.lower("path") == t) | (F.lower("name") == t))
    return files.where(functools.reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t)) for c in ("path", "category")]))


def policy_findings(files: DataFrame, required: DataFrame, most: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """path, message of files that break a rule, and of required ones (path) that aren't there."""
    parts = F.split(F.lower("path"), "/")
    hidden = F.arrays_overlap(parts, F.array(*map(F.lit, rules.FORBIDDEN_PARTS)))
    other = F.array_compact(F.array(F.when(F.col("suffix").isin(*rules.FORBIDDEN_SUFFIXES), F.lit("large model/checkpoint-style binary should not be tracked")), F.when(F.col("bytes") > most, F.lit(f"tracked file exceeds {most} bytes"))))
    found = files.select("path", F.explode(F.when(hidden, F.array(F.lit("local cache or virtual-environment path is tracked"))).otherwise(other)).alias("message"))
    lost = required.join(files.select("path"), "path", "left_anti").select("path", F.lit("required handoff artifact is missing").alias("message"))
    return found.unionByName(lost)


def bundle_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names made unique by a number, roles and hashes of a folder's files."""
    from pyspark.sql import Window

    role = F.when(F.contains("name", F.lit("predict")), "predictions").when(F.contains("name", F.lit("graph")), "graph").when(F.contains("name", F.lit("queue")), "queue").otherwise("other")
    rows = listing(spark, path, content=True).select("path", "name", "bytes", role.alias("role"), F.sha2("content", 256).alias("sha256"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    return rows.withColumn("r", rank).withColumn("target", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat(F.col("r").cast("string"), F.lit("_"), "name"))).drop("r")


def bundle_verify(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """path, problem of manifest rows whose file is missing or has another hash."""
    now = listing(spark, path, content=True).select("path", F.sha2("content", 256).alias("now"))
    met = manifest.join(now, "path", "left")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "checksum mismatch")
    return met.select("path", problem.alias("problem")).where("problem is not null")


def rounds(files: DataFrame, pattern: str = r"^(evidence|entities|queue)_round(\d+)\.jsonl$", kinds: int = 3) -> DataFrame:
    """Round numbers of file names of which all kinds are there."""
    r = files.select(F.regexp_extract("name", pattern, 1).alias("kind"), F.regexp_extract("name", pattern, 2).alias("round")).where("kind <> ''")
    return r.groupBy(F.col("round").cast("int").alias("round")).agg(F.count_distinct("kind").alias("n")).where(F.col("n") == kinds).select("round")
