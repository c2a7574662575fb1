"""Model documentation as texts: assemble, shorten, identify, store once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest text kept whole, and the mark put behind a shortened one.
MAX_TEXT_LENGTH = 2000
TRUNCATION_MARK = "... [truncated]"
_CHUNK = 1024


def doc_build(lines: DataFrame) -> DataFrame:
    """One text per model from its column lines.

    Input: ``file_path``, ``model_name``, ``description``, ``column_pos``, ``column_name``,
    ``column_description``; a model without columns has one row with a NULL column. Lines are
    joined in two steps, by runs of positions and then by model, so that a very
    long document is put together from pieces made in parallel.
    """
    keys = ["file_path", "model_name"]
    line = F.concat(
        F.lit("- "),
        F.col("column_name"),
        F.lit(": "),
        F.coalesce("column_description", F.lit("")),
    )
    chunks = (
        lines.groupBy(*keys, F.floor(F.col("column_pos") / _CHUNK).alias("chunk"))
        .agg(
            F.max("description").alias("description"),
            F.sort_array(
                F.collect_list(F.when(line.isNotNull(), F.struct("column_pos", line.alias("line"))))
            ).alias("_lines"),
        )
        .select(
            *keys,
            "chunk",
            "description",
            F.when(
                F.size("_lines") > 0,
                F.array_join(F.transform("_lines", lambda e: e["line"]), "\n"),
            ).alias("piece"),
        )
    )
    return (
        chunks.groupBy(*keys)
        .agg(
            F.max("description").alias("description"),
            F.sort_array(
                F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("chunk", "piece")))
            ).alias("_pieces"),
        )
        .select(
            *keys,
            _strip(
                F.concat(
                    F.lit("Model: "),
                    F.col("model_name"),
                    F.lit("\nDescription: "),
                    F.coalesce("description", F.lit("")),
                    F.lit("\n\nColumns:\n"),
                    F.array_join(F.transform("_pieces", lambda e: e["piece"]), "\n"),
                )
            ).alias("text"),
        )
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def doc_truncate(text: Column, max_length: int = MAX_TEXT_LENGTH) -> Column:
    """Texts over the limit are cut ten characters short of it and marked as cut."""
    return F.when(
        F.length(text) > max_length,
        F.concat(F.substring(text, 1, max_length - 10), F.lit(TRUNCATION_MARK)),
    ).otherwise(text)


def doc_id_md5(file_path: Column, model_name: Column) -> Column:
    return F.md5(F.concat(file_path, F.lit("::"), model_name))


def incremental_dedupe(incoming: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose id is not stored yet, each id once.

    A changed text under a stored id is not taken up. Among copies of an id in the
    input the smallest row wins.
    """
    rest = [c for c in incoming.columns if c != key]
    single = incoming.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return (
        single.join(stored.select(key), key, "left_anti")
        .select(key, "_row.*")
        .select(*incoming.columns)
    )


def embed_stats(statuses: DataFrame) -> DataFrame:
    """Counts from rows of ``file_path`` and ``status`` (embedded, error, skipped)."""
    status = F.col("status")
    return statuses.agg(
        F.count_if(status == "embedded").alias("embedded"),
        F.count_if(status == "error").alias("errors"),
        F.count_distinct("file_path").alias("files"),
    )
