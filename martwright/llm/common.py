"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import marking
from martwright.operators.durable import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the folder all nodes share and continue from the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that broadcasts neither side, whatever Spark takes their sizes for.

    Spark counts an exploded table as large as the one it comes from and an array as one element, so
    tables many times the broadcast threshold pass for small ones and fill the driver's memory.
    """
    return df.hint("merge")


def digest_of(text: str) -> Column:
    """MD5 of a text; a null text has one that no other text has."""
    return F.coalesce(F.md5(F.col(text)), F.lit(""))


MOST_BITS = marking.MOST_BITS


def perhaps_in(df: DataFrame, key: list[Column], few: DataFrame, few_key: list[Column]) -> DataFrame:
    """``marking.perhaps_in`` with at most MOST_BITS: texts that are not marked need no shuffle."""
    return marking.perhaps_in(df, key, few, few_key, MOST_BITS)


def about(df: DataFrame, hashed: str, limit: int, rows: int | None = None) -> DataFrame:
    """The rows with hashes below a bound that about twice ``limit`` rows are expected to meet.

    ``hashed`` is a 64-bit hash with few equal values; ``rows`` is the number of rows, if known.
    """
    total = df.count() if rows is None else rows
    share = min(1.0, 2 * limit / max(total, 1))
    return df.where(F.col(hashed) / 2.0**64 + 0.5 <= share)


def smallest(
    df: DataFrame, hashed: str, limit: int, *ties: str, rows: int | None = None
) -> DataFrame:
    """The ``limit`` rows with the smallest hashes (or, in rare cases, some fewer).

    However many tasks there are, together they send the driver about twice as many rows.
    """
    return about(df, hashed, limit, rows).orderBy(hashed, *ties).limit(limit)


def per_worker(key: str, build: Callable):
    """A value built once in each Python worker process.

    Functions of this package travel with each task, so their own globals do not outlive it.
    """
    kept = pyspark.__dict__.setdefault("_martwright_per_worker", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]
