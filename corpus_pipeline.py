"""A cleaning pipeline over documents: quality, exact copies, near copies, repeated passages, packing.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs one stage's tasks at most.

Defined cases, for all stages: a null text counts as empty and stays null; texts of any length are read whole; rows without a
doc_id are told apart by their texts; of rows that repeat doc_id and text one stays after the exact stage; ties go to the largest
doc_id there and to the least in the near stage; further columns pass through the first four stages unchanged, whatever their
names (n_chars follows text where passages go); an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.additive_quality import passing_documents
from sievework.llm.chunk_recipes import without_copies
from sievework.llm.cutting_stock import pack
from sievework.llm.minhash_join import without_near_copies
from sievework.llm.shared import documents, stage
from sievework.llm.suffix_dedup import without_repeats

#: Passages of over 50 words are to go; 50 words of prose are rarely shorter than this, whereas 20 words always are.
PASSAGE_BYTES, PASSAGE_GRAM = 240, 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return passing_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return without_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated passages of PASSAGE_BYTES or more taken out of their texts."""
    return without_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("suffix-array dedup", passages), ("packing", packing)]

#: The classifier is learned, so SQL can't express the rows; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
