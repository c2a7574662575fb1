"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``, whatever they are beyond doc_id and text. Rows
are kept or dropped by what holds for their own text, whether ``doc_id`` is null or shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import decontaminate, langid, line_dedup, neardup, packing
from martwright.llm.common import digest_of, perhaps_in, stored, table

LEAST_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` and the digest of its text, by which, with its id, decisions are applied."""
    return docs.select(F.struct("*").alias("row"), digest_of("text").alias("digest"))


def _without(marked: DataFrame, dropped: DataFrame, same: Column) -> DataFrame:
    """``row`` of the rows without a match; those that are not marked stay where they are."""
    doubtful = marked.where("_perhaps").join(dropped, same, "left_anti")
    return marked.where(~F.col("_perhaps")).select("row").unionByName(doubtful.select("row"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays in doubt."""
    judged = langid.predict(docs, langid.train(docs))
    known = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    return judged.where(known).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that ten or more documents share out of every text; drop emptied documents."""
    bitmaps = stored(line_dedup.keep_bitmaps(docs), "line-bitmaps")
    applied = line_dedup.apply_bitmaps(docs, bitmaps)
    changed = F.col("n_dropped") > 0
    columns = []
    for name in docs.columns:
        column = F.col("row")[name]
        if name == "text":
            column = F.when(changed, F.col("kept_text")).otherwise(column)
        elif name == "n_chars":
            column = F.when(changed, F.length("kept_text").cast("long")).otherwise(column)
        columns.append(column.alias(name))
    emptied = changed & (F.btrim("kept_text", F.lit(line_dedup.BLANKS)) == "")
    return applied.where(~emptied).select(*columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every component of near copies: one with the smallest id (null last).

    Of rows with this id the text digest decides, and then the row's other columns.
    """
    linked = neardup.link_rows(docs.select("doc_id", "text")).where(F.col("least").isNotNull())
    # Rows of a key have one text, so they lie in one component.
    decided = stored(
        linked.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.max("least").alias("least"), F.count("*").alias("n"))
        .where(~F.col("least") | (F.col("n") > 1)),
        "pipeline-copies",
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    key = [F.col("row.doc_id").cast("long"), F.col("digest")]
    marked = perhaps_in(_keyed(docs), key, decided, [F.col("_id"), F.col("_digest")])
    rest = _without(marked, decided, same)
    repeated = decided.where("least")
    if not repeated.isEmpty():
        one = F.min_by("row", F.to_json("row")).alias("row")
        again = marked.where("_perhaps").join(repeated, same, "left_semi")
        rest = rest.unionByName(again.groupBy("row.doc_id", "digest").agg(one).select("row"))
    return rest.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text holds a benchmark item."""
    texts = docs.select(digest_of("text").alias("digest"), "text")
    benchmark = table(spark, sf_dir, "benchmark")
    leaks = decontaminate.find_leaks(texts, benchmark, doc_id="digest", id_type="string")
    leaking = stored(leaks.select(F.col("doc_id").alias("_digest")).distinct(), "pipeline-leaks")
    marked = perhaps_in(_keyed(docs), [F.col("digest")], leaking, [F.col("_digest")])
    return _without(marked, leaking, F.col("digest") == F.col("_digest")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))
