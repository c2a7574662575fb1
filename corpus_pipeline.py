"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; each
result is written as Parquet below the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martwright.llm import stages
from martwright.llm.common import stored, table

STAGES = [
    ("language ID", stages.keep_known_language),
    ("line dedup", stages.drop_repeated_lines),
    ("MinHash near-dedup", stages.keep_one_of_near_copies),
    ("benchmark decontamination", stages.drop_leaks),
    ("packing", stages.pack),
]

# The language model, BM25 retrieval and tokenization cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
