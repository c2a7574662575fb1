"""CSV files: reading with a fallback encoding, writing, and a shape check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import ascii_clean_columns


def files_with_invalid_utf8(spark: SparkSession, path: str) -> list[str]:
    """Files holding bytes that are not UTF-8; only their names reach the driver."""
    return [
        row[0]
        for row in spark.read.text(path)
        .where(~F.is_valid_utf8("value"))
        .select(F.col("_metadata.file_path"))
        .distinct()
        .collect()
    ]


def read_csv_encoded(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True
) -> DataFrame:
    """CSV files as UTF-8, and each file that is not valid UTF-8 as Latin-1."""

    def read(paths: str | list[str], encoding: str) -> DataFrame:
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", encoding)
            .csv(paths)
        )

    latin = set(files_with_invalid_utf8(spark, path))
    if not latin:
        return read(path, "UTF-8")
    utf8 = [f for f in _files(spark, path) if f not in latin]
    other = read(sorted(latin), "ISO-8859-1")
    return read(utf8, "UTF-8").unionByName(other) if utf8 else other


def _files(spark: SparkSession, path: str) -> Iterable[str]:
    """The file names Spark has listed for the path, in the spelling of ``_metadata``."""
    names = spark.read.format("binaryFile").load(path).select("_metadata.file_path")
    return [row[0] for row in names.distinct().collect()]


def sink_csv(
    df: DataFrame, path: str, encoding: str = "UTF-8", max_records: int = 100_000
) -> str:
    """Header, no index column, UTF-8; files of at most ``max_records`` records.

    A file whose records may run over several lines is read by one task, so the writer bounds it.
    """
    (
        df.write.mode("overwrite")
        .option("maxRecordsPerFile", max_records)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", encoding)
        .csv(path)
    )
    return path


def clean_csv(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> str:
    """CSV files of either encoding to UTF-8 files whose text columns are plain ASCII."""
    return sink_csv(ascii_clean_columns(read_csv_encoded(spark, source, schema)), target)


# A quoted field that closes, or that runs on past the end of the line.
_QUOTED = r'(^|,)"(?:[^"]|"")*+("|$)'
_STAND_IN = "\ue001"


def _scan(line: Column) -> tuple[Column, Column]:
    """Commas outside quotes, and 1 if the line ends inside a quoted field."""
    plain = F.regexp_replace(line, _QUOTED, "$1" + _STAND_IN + "$2")
    commas = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit("")))
    return commas, plain.endswith(_STAND_IN).cast("int")


def _state_after(rows: DataFrame, group: list[str], order: str, names: tuple[str, str, str]) -> DataFrame:
    """Follow the quote state (0 outside, 1 inside) along ordered steps of each group.

    ``names`` are the columns with the state after a step that began in 0, the one
    after a step that began in 1, and the result. A step that leads to one state either
    way settles it; otherwise it keeps or flips it, and flips only need counting. Adds the
    result for a group begun in state 0, and ``settled`` where the start no longer matters.
    """
    from_out, from_in, result = names
    settles = F.col(from_out) == F.col(from_in)
    upto = (
        Window.partitionBy(*group)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = rows.withColumn(
        "_flips", F.sum(F.when(settles, 0).otherwise(F.col(from_out))).over(upto)
    )
    base = F.when(settles, (F.col(from_out) + F.col("_flips")) % 2)
    return (
        counted.withColumn("_base", F.last(base, ignorenulls=True).over(upto))
        .withColumn(result, (F.coalesce("_base", F.lit(0)) + F.col("_flips")) % 2)
        .withColumn("settled", F.col("_base").isNotNull())
        .drop("_flips", "_base")
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record`` (the header is 1) and ``fields`` for every CSV record.

    Quoted fields may hold commas, doubled quotes and line breaks; a blank line is a
    record without fields. Files are read in splits and no record is ever put together:
    each line gives its commas and end state for both states it may begin in. The
    state is followed within each split, then along the splits of a file, and the comma
    counts of the lines of a record are added up.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    commas_out, end_out = _scan(F.col("line"))
    commas_in, end_in = _scan(F.concat(F.lit('"'), F.col("line")))
    scanned = lines.select(
        "file",
        "block",
        "at",
        (F.length("line") == 0).alias("blank"),
        commas_out.alias("commas_out"),
        commas_in.alias("commas_in"),
        end_out.alias("end_out"),
        end_in.alias("end_in"),
    )
    followed = _state_after(scanned, ["file", "block"], "at", ("end_out", "end_in", "after"))

    # A split as one step: what it does to the state it begins in.
    splits = (
        followed.groupBy("file", "block")
        .agg(F.max_by(F.struct("after", "settled"), "at").alias("e"))
        .select(
            "file",
            "block",
            F.col("e.after").alias("split_out"),
            F.when(F.col("e.settled"), F.col("e.after")).otherwise(1 - F.col("e.after")).alias(
                "split_in"
            ),
        )
    )
    along = Window.partitionBy("file").orderBy("block")
    begins = _state_after(splits, ["file"], "block", ("split_out", "split_in", "end")).select(
        "file", "block", F.coalesce(F.lag("end").over(along), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("file", "block").orderBy("at")
    after = F.when(F.col("settled"), F.col("after")).otherwise(
        (F.col("after") + F.col("start")) % 2
    )
    placed = (
        followed.join(begins, ["file", "block"])
        .withColumn("after", after)
        .withColumn("begin", F.coalesce(F.lag("after").over(inside), F.col("start")))
        .withColumn("opens", 1 - F.col("begin"))
        .withColumn(
            "local", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
    )
    offsets = (
        placed.groupBy("file", "block")
        .agg(F.sum("opens").alias("n"))
        .select(
            "file",
            "block",
            F.coalesce(
                F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("offset"),
        )
    )
    commas = F.when(F.col("begin") == 1, F.col("commas_in")).otherwise(F.col("commas_out"))
    return (
        placed.join(offsets, ["file", "block"])
        .groupBy("file", (F.col("local") + F.col("offset")).alias("record"))
        .agg(
            F.when(F.bool_and(F.col("blank") & (F.col("begin") == 0)), F.lit(0))
            .otherwise(F.sum(commas) + 1)
            .alias("fields")
        )
    )


def csv_shape(spark: SparkSession, path: str, report: int = 20) -> DataFrame:
    """The first records whose field count differs from the header's, with the total."""
    records = csv_records(spark, path)
    header = records.where(F.col("record") == 1).select("file", F.col("fields").alias("expected"))
    wrong = records.join(header, "file").where(F.col("fields") != F.col("expected"))
    total = wrong.agg(F.count("*")).scalar()
    return (
        wrong.orderBy("file", "record")
        .limit(report)
        .select("file", "record", "fields", "expected", total.alias("total_errors"))
    )
