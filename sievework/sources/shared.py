"""Tables written to the folder that all executors share, so that lineage ends there and a lost executor costs a stage at most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, LOCAL_DIR for a session in one process and an error elsewhere:
    on a cluster every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; every call differs, so reruns never meet older files."""
    return f"{shared_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Staged tables of one operator. drop() removes them, once what is returned is staged by itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return _written(df, path)

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()
