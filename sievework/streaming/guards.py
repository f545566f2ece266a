"""Runs of a stream that are skipped while one is on, and waits with a soft and a hard deadline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def single_flight(spark: SparkSession, name: str, writer: DataStreamWriter) -> StreamingQuery | None:
    """Start writer as the query called name over what is there, or None if that query is active. A checkpoint folder takes one
    query at a time; Spark itself refuses a second one of another session."""
    if any(q.name == name and q.isActive for q in spark.streams.active):
        return None
    return writer.queryName(name).trigger(availableNow=True).start()


def waited(run: StreamingQuery, soft: float, hard: float, warn: Callable[[], None] = lambda: None) -> str:
    """Wait for a query: 'done', 'late' if it took longer than soft seconds (warn is called once), 'stopped' beyond hard seconds.
    A stopped query resumes from its checkpoint."""
    if run.awaitTermination(soft):
        return "done"
    warn()
    if run.awaitTermination(max(0.001, hard - soft)):
        return "late"
    run.stop()
    return "stopped"
