"""Streams: issue windows, deduplication by key, and the lease state machine as a pure transition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import new_path
from .slots import fed

DELAY = "10 minutes"


def window_counts(events: DataFrame) -> DataFrame:
    """Counts by 24-hour window (from 22:00 UTC) and type; late rows beyond DELAY are dropped by the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", DELAY)
    counts = timed.groupBy(F.window("at", "1 day", "1 day", "22 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events with new keys only, within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", DELAY).dropDuplicatesWithinWatermark(keys)


def drained_window_counts(spark: SparkSession, path: str) -> DataFrame:
    """Read what is there as a stream, write the closed windows to the shared folder, and return them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    top = new_path(spark, "stream")
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)
    out = window_counts(stream)
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


def frozen(spark: SparkSession, states: list[DataFrame]) -> list[DataFrame]:
    """Send states through a stream, a micro-batch each, and freeze every batch in the shared folder as it comes.

    A batch that is run again after a failure writes over its own folder, so each is frozen once."""
    top = new_path(spark, "frozen")

    def keep(batch: DataFrame, k: int) -> None:
        batch.withColumn("step", F.lit(k)).write.partitionBy("step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{top}/out")

    fed(spark, states, lambda stream: stream.writeStream.foreachBatch(keep), top)
    kept = spark.read.schema(StructType([*states[0].schema.fields, StructField("step", IntegerType())])).parquet(f"{top}/out")
    return [kept.filter(F.col("step") == k).drop("step") for k in range(len(states))]
