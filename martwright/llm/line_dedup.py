"""Exact line deduplication that returns compressed keep bitmaps.

Method: every line is reduced to the md5 of its key. The (hash, document, position) rows are
range-partitioned on (hash, document) and sorted by (hash, document, position). The document is
part of the range key, so a line that a third of all documents share is spread over many
partitions (slices). First occurrences are streamed from the sorted runs without another shuffle:
a row is one if no row of the same hash and document stands before it. Counting them gives the
documents of a hash, and the counts go back to the slices in which the hash lies.
Only DataFrame functions are used.

Defined results: a null or empty text is one empty line; rows with the same ``doc_id`` are one
document when documents are counted, and each row keeps its own bitmap; rows without ``doc_id``
count as one document. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
WORD = 64  # lines in a word of a bitmap
# What lower() may change beyond ASCII: capitals, and code points that the regex library does not
# know; a test goes through all of them.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z lower-cased.

    ``translate`` looks up every character, at forty times the price of ``lower``, so it is left to
    lines in which ``lower`` would change more than A to Z; blanks are cut where there are any.
    """
    blank_end = reduce(or_, [line.startswith(b) | line.endswith(b) for b in BLANKS])
    text = F.when(blank_end, F.btrim(line, F.lit(BLANKS))).otherwise(line)
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(OTHER_UPPER)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("_doc"), F.xxhash64(whole).alias("_version"), whole.alias("_text")
    )


def keep_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
) -> DataFrame:
    """Bitmaps of the documents that lose lines; a document not listed keeps all its lines.

    Output: ``_doc``, ``_version`` (xxhash64 of the text), ``n_dropped`` and ``keep``: bit
    i % 64 of word i // 64 says whether line i is kept; words after the last lost line are left out.
    """
    lines = _prepared(docs, doc_id, text).select(
        "_doc", "_version", F.posexplode(F.split("_text", "\n")).alias("_position", "_line")
    )
    hashes = lines.select(
        "_doc", "_version", "_position", line_key(F.col("_line")).alias("_key")
    ).where(F.length("_key") >= min_chars)
    hashes = hashes.select(F.unhex(F.md5("_key")).alias("_hash"), "_doc", "_version", "_position")
    # Stored, as range bounds are taken from a sample before the rows are dealt: texts are split once.
    hashes = stored(hashes, "line-hashes")
    order = ["_version", "_position"]
    before = F.lag("_position").over(Window.partitionBy("_hash", "_doc").orderBy(*order))
    runs = (
        hashes.repartitionByRange("_hash", "_doc")
        .sortWithinPartitions("_hash", "_doc", *order)
        .select("*", before.isNull().alias("_first"), F.spark_partition_id().alias("_slice"))
    )
    runs = stored(runs, "line-runs")
    # A hash lies in neighbouring slices. Places meet its count slice by slice, so that a line that
    # many documents share is no hot key of the join.
    slices = F.sequence(F.min("_slice"), F.max("_slice"))
    frequent = (
        runs.groupBy("_hash")
        .agg(F.count_if("_first").alias("_docs"), slices.alias("_slices"))
        .where(F.col("_docs") >= min_docs)
        .select("_hash", F.explode("_slices").alias("_slice"))
    )
    places = runs.join(frequent, ["_hash", "_slice"])
    position = F.col("_position")
    words = places.groupBy(
        "_doc", "_version", F.floor(position / WORD).cast("int").alias("word")
    ).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), position % WORD)).alias("lost"))
    listed = words.groupBy("_doc", "_version").agg(
        F.sum(F.bit_count("lost")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("kept")))).alias(
            "_words"
        ),
    )
    return listed.select("_doc", "_version", "n_dropped", _filled(F.col("_words")).alias("keep"))


def _filled(words: Column) -> Column:
    """All words of a bitmap from its sorted (word, kept) that lose a line."""
    numbers = F.transform(words, lambda w: w["word"])
    before = F.concat(F.array(F.lit(-1)), F.slice(numbers, 1, F.size(words) - 1))
    every = F.lit(-1).cast("long")
    return F.flatten(
        F.transform(
            F.arrays_zip(words.alias("own"), before.alias("before")),
            lambda w: F.concat(
                F.array_repeat(every, w["own"]["word"] - w["before"] - 1), F.array(w["own"]["kept"])
            ),
        )
    )


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set, or that lie beyond the bitmap; one pass."""

    def is_kept(_: Column, i: Column) -> Column:
        word = F.get(keep, F.floor(i / WORD).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, i % WORD).bitwiseAND(F.lit(1))
        return F.coalesce(bit, F.lit(1)) == 1

    return F.filter(lines, is_kept)


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row`` (all columns of a document), ``n_lines``, ``n_dropped``, ``keep``, ``kept_text``.

    ``keep`` is NULL where all lines are kept.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_whole"),
    ).withColumn("_row_version", F.xxhash64("_whole"))
    joined = rows.join(
        bitmaps.select("_doc", "_version", "n_dropped", "keep"),
        F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_row_version") == F.col("_version")),
        "left",
    )
    lines = F.split("_whole", "\n")
    kept = F.array_join(kept_lines(lines, F.col("keep")), "\n")
    return joined.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        F.when(F.col("keep").isNotNull(), kept).otherwise(F.col("_whole")).alias("kept_text"),
    )
