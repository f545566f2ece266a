"""Shared-folder staging and small helpers for the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import Scratch, drop_path, new_path, stage

__all__ = ["Recent", "Scratch", "documents", "drop_path", "fresh", "new_path", "quoted", "stage"]


def quoted(column: str) -> str:
    """A column's name as Spark's expressions take it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """names, made longer where docs has columns of these names, so that joined helper columns clash with none."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Recent(dict):
    """A bounded memo of make(key): when limit keys are held they become the older generation, whose keys are still found."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
