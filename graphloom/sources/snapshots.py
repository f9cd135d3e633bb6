"""Stored tables that change by whole snapshots.

A table is a folder: each snapshot's rows are Parquet files in a folder of their own, and a small manifest a version says
which folder holds them. A version is there once its manifest is: the manifest is written under another name and renamed to
a name that must not exist, so a failed or a second writer leaves the last version as it was. Readers take the highest
version. Nothing but the manifest's few fields passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Snapshot(NamedTuple):
    """A version's manifest."""

    version: int
    folder: str
    schema: str
    rows: int
    parent: int


class SnapshotConflict(RuntimeError):
    """Another writer made the version first."""


class SnapshotTable:
    """A table of snapshots in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _hadoop(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self._conf), path

    def versions(self) -> list[int]:
        fs, folder = self._hadoop("_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The manifest of a version, of the latest by default; None for a table without one."""
        found = self.versions()
        if version is None:
            if not found:
                return None
            version = found[-1]
        elif version not in found:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        fs, path = self._hadoop(f"_versions/{version:012d}.json")
        stream = fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.snapshot(version)
        if found is None:
            return None
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(f"{self.path}/{found.folder}")

    def write(self, rows: DataFrame, overwrite: bool = False) -> Snapshot:
        """A new version of these rows. A table that has one is refused without `overwrite`."""
        last = self.snapshot()
        if last is not None and not overwrite:
            raise FileExistsError(f"{self.path} has version {last.version}; overwrite it to go on")
        return self._commit(rows, last)

    def upsert(self, rows: DataFrame, key: str | list[str], latest: list[Column] | None = None, overwrite: bool = False) -> Snapshot:
        """A new version: rows win over stored ones of the same key (nulls are a key like any other), columns that one side
        lacks are null. Of several rows with one key the first by `latest` is taken; without an order they are an error."""
        keys = [key] if isinstance(key, str) else key
        last = self.snapshot()
        if last is not None and not overwrite:
            raise FileExistsError(f"{self.path} has version {last.version}; overwrite it to go on")
        if latest:
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))
            rows = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        else:
            many = F.count("*").over(Window.partitionBy(*keys)) > 1
            text = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
            rows = rows.withColumn("_many", F.when(many, F.raise_error(F.concat(F.lit("more than one row for key "), text)))).where("_many is null").drop("_many")
        stored = self.read()
        if stored is not None:
            new = rows.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
            rows = rows.unionByName(stored.join(new, same, "left_anti"), allowMissingColumns=True)
        return self._commit(rows, last)

    def _commit(self, rows: DataFrame, last: Snapshot | None) -> Snapshot:
        from pyspark.sql import Observation

        version, folder, seen = (last.version if last else 0) + 1, f"data-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{folder}")
        made = Snapshot(version, folder, rows.schema.json(), int(seen.get["rows"]), last.version if last else 0)
        fs, draft = self._hadoop(f"_versions/.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(json.dumps(made._asdict()).encode())
        finally:
            stream.close()
        _, final = self._hadoop(f"_versions/{version:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise SnapshotConflict(f"{self.path}: version {version} was made by another writer")
        return made

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes all but the last `keep` versions, manifests first; the versions that went."""
        gone = self.versions()[: -max(keep, 1)]
        for version in gone:
            folder = self.snapshot(version).folder
            for name in (f"_versions/{version:012d}.json", folder):
                fs, path = self._hadoop(name)
                fs.delete(path, True)
        return gone
