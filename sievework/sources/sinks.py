"""Writes: a batch beside its quarantine, and a keyed table in versions that are swapped by compare-and-set."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_path


class Conflict(RuntimeError):
    """The table has moved on since the version that a write was made from."""


def write_valid(rows: DataFrame, error: Column, path: str) -> DataFrame:
    """Append the rows without an error to path/valid and the others, with it, to path/aside; what is there is returned.

    One pass writes both, so a bad row doesn't sink the batch and none is lost."""
    marked = rows.withColumn("error", error)
    marked.withColumn("part", F.when(F.col("error").isNull(), "valid").otherwise("aside")).write.partitionBy("part").mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


class VersionedTable:
    """A keyed table whose versions are plain Parquet folders. Every writer of a version writes a folder of its own; of those
    that ended, by the marker that Spark leaves, the first is the version. Nothing is locked or renamed: a writer that dies
    leaves a folder that nobody reads, and one that ends second gets a Conflict and its folder is removed."""

    #: Seconds after which the time of a finished folder is surely earlier than that of any later one.
    GRAIN = 1.0

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._files = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        top = self._new(path)
        return [s.getPath().getName() for s in self._files.listStatus(top)] if self._files.exists(top) else []

    def _ended(self, version: int) -> list[tuple[int, str]]:
        """(time, folder) of the finished folders of a version, the first one first."""
        folders = [f"{self.path}/v{version}/{n}" for n in self._names(f"{self.path}/v{version}")]
        marks = [(f, self._new(f"{f}/_SUCCESS")) for f in folders]
        return sorted((self._files.getFileStatus(m).getModificationTime(), f) for f, m in marks if self._files.exists(m))

    def version(self) -> int:
        """The newest version with a finished folder, 0 if there is none."""
        found = sorted((int(n[1:]) for n in self._names(self.path) if re.fullmatch(r"v\d+", n)), reverse=True)
        return next((v for v in found if self._ended(v)), 0)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._ended(version)[0][1])

    def write(self, rows: DataFrame, after: int) -> int:
        """Write rows as the version that follows after; Conflict if another writer was faster."""
        if self.version() != after:
            raise Conflict(f"version {after} is not the newest")
        made = f"{self.path}/v{after + 1}/{uuid.uuid4().hex}"
        rows.write.parquet(made)
        time.sleep(self.GRAIN)
        if self._ended(after + 1)[0][1] != made:
            drop_path(self.spark, made)
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    def upsert(self, rows: DataFrame, may: Column) -> tuple[int, DataFrame]:
        """Insert rows with new keys and replace those whose held row (struct held) meets may -> (version, outcome by key).

        may is a condition on the columns of rows and of held, such as a lease that is over."""
        now = self.version()
        if not now:
            return self.write(rows, 0), rows.select(self.key, F.lit("inserted").alias("outcome"))
        held = self.read(now).select(F.col(self.key).alias("held_key"), F.struct("*").alias("held"))
        met = rows.select(F.col(self.key).alias("new_key"), F.struct("*").alias("new")).join(held, F.col("new_key") == F.col("held_key"), "full_outer")
        take = F.col("held").isNull() | (F.col("new").isNotNull() & may)
        version = self.write(met.select(F.when(take, F.col("new")).otherwise(F.col("held")).alias("r")).select("r.*"), now)
        outcome = F.when(F.col("held").isNull(), "inserted").when(take, "updated").otherwise("refused")
        return version, met.filter("new is not null").select(F.col("new_key").alias(self.key), outcome.alias("outcome"))

    def delete(self, keys: DataFrame) -> int:
        """Write a version without the rows of keys."""
        now = self.version()
        return self.write(self.read(now).join(keys.select(self.key).distinct(), self.key, "left_anti"), now)
