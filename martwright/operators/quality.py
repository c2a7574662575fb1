"""Data-quality checks. Each returns what fails; an empty result means the check holds.

Violations have one shape: ``column_name``, ``value`` (text) and ``failures`` (rows).
Values are counted before anything is shuffled on them, so a frequent value costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(df: DataFrame, picks: dict[str, Column]) -> DataFrame:
    """Count the values of the picked columns where the condition holds, in one pass."""
    failing = [
        F.when(condition, F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
        for c, condition in picks.items()
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*failing))).alias("_v"))
        .groupBy("_v.column_name", "_v.value")
        .agg(F.count("*").alias("failures"))
    )


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a value per column, all columns in one pass; also lists the zeros."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(None).cast("string").alias("value"),
                        F.col(c).alias("failures"),
                    )
                    for c in columns
                ]
            )
        ).alias("_v")
    ).select("_v.*")


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values, other than NULL, that occur more than once."""
    return _values(df, {c: F.col(c).isNotNull() for c in columns}).where(F.col("failures") > 1)


def relationships(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Child values, other than NULL, that the parent lacks."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("failures")
    )
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return used.join(known, column, "left_anti").select(
        F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"), "failures"
    )


def accepted_values(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Values, other than NULL, outside the list."""
    return _values(df, {column: ~F.col(column).isin(list(values))})


def in_set(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """The same rule under the name of the column-expectation check."""
    return accepted_values(df, column, values)


def between(df: DataFrame, limits: dict[str, tuple[object | None, object | None]]) -> DataFrame:
    """Values outside their inclusive limits; an open end is None and NULL passes."""
    return _values(df, {c: outside(c, low, high) for c, (low, high) in limits.items()})


def outside(column: str, low: object | None, high: object | None) -> Column:
    """Whether a value lies outside inclusive limits; an open end is None and NULL passes."""
    below = F.lit(False) if low is None else F.col(column) < low
    above = F.lit(False) if high is None else F.col(column) > high
    return F.coalesce(below | above, F.lit(False))


def counted(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Rows that break each rule (check, column, condition of failing): one aggregation for all.

    Columns: ``check``, ``column_name``, ``row_count`` and ``failures``, with the zeros. Only sums are
    shuffled, and the table is read once, in the columns that have rules.
    """
    sums = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(failing).alias(f"_f{i}") for i, (_, _, failing) in enumerate(rules)],
    )
    listed = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column_name"),
            F.col("_rows").alias("row_count"),
            F.col(f"_f{i}").alias("failures"),
        )
        for i, (check, column, _) in enumerate(rules)
    ]
    return sums.select(F.inline(F.array(*listed)))


def schema_contract(documented: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between two lists of (``model``, ``column_name``), in both directions.

    Names are compared in lower case. Use :func:`columns_as_rows` for the actual side.
    """

    def names(df: DataFrame) -> DataFrame:
        return df.select("model", F.lower("column_name").alias("column_name")).distinct()

    keys = ["model", "column_name"]
    missing = names(documented).join(names(actual), keys, "left_anti")
    extra = names(actual).join(names(documented), keys, "left_anti")
    return missing.withColumn("problem", F.lit("documented, not produced")).unionByName(
        extra.withColumn("problem", F.lit("produced, not documented"))
    )


def columns_as_rows(model: str, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(model, c) for c in df.columns], "model string, column_name string"
    )
