"""Table profiles: one row per column, worked out in distributed passes.

``value_counts`` turns the table into (column, value, count) with map-side counting, so
frequent values cost nothing extra; everything about distinct values comes from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import ladder
from martwright.operators.durable import durable
from martwright.operators.ordering import exact_quantiles


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def _present(df: DataFrame, column: str) -> Column:
    """The column with NaN taken as missing."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _kind(f.dataType) == "numeric"]


def value_counts(df: DataFrame) -> DataFrame:
    """``position``, ``value`` (text, NULL included) and ``n`` for every column."""
    cells = [
        F.struct(
            F.lit(position).alias("position"),
            _present(df, c).cast("string").alias("value"),
        )
        for position, c in enumerate(df.columns)
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("_c"))
        .groupBy("_c.position", "_c.value")
        .agg(F.count("*").alias("n"))
    )


def _names(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), _kind(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, dtype string, kind string"
    )


def profile_columns(
    df: DataFrame,
    approximate: bool = False,
    samples: int = 5,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Type, distinct values, missing values and sample values per column.

    ``counts`` are the :func:`value_counts` of the table, if they are at hand.

    The samples are the smallest values in text order, which is repeatable. With
    ``approximate`` the distinct counts are estimated in a single pass without shuffling
    values, and no samples are given.
    """
    names = _names(df)
    if approximate:
        facts = df.agg(
            F.count("*").alias("_rows"),
            *[F.approx_count_distinct(_present(df, c)).alias(f"d{i}") for i, c in enumerate(df.columns)],
            *[F.count_if(_present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
        )
        stats = facts.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("position"),
                            F.col("_rows").alias("row_count"),
                            F.col(f"d{i}").alias("unique_count"),
                            F.col(f"m{i}").alias("null_count"),
                            F.array().cast("array<string>").alias("sample_values"),
                        )
                        for i in range(len(df.columns))
                    ]
                )
            ).alias("_s")
        ).select("_s.*")
    else:
        # The limit of rows per column lets Spark cut each partition before the shuffle.
        first = Window.partitionBy("position").orderBy(F.col("value").asc_nulls_last())
        counts = value_counts(df) if counts is None else counts
        sums = counts.groupBy("position").agg(
            F.sum("n").alias("row_count"),
            F.count("value").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
                "null_count"
            ),
        )
        picked = (
            counts.where(F.col("value").isNotNull())
            .withColumn("_r", F.row_number().over(first))
            .where(F.col("_r") <= samples)
            .groupBy("position")
            .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
        )
        stats = sums.join(picked, "position", "left")
    return names.join(stats, "position").select(
        "position",
        "column_name",
        "dtype",
        "kind",
        "row_count",
        "unique_count",
        "null_count",
        F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count") * 100).alias(
            "null_percentage"
        ),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def profile_numeric(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, median, sample deviation, minimum and maximum of the numeric columns.

    Columns with exactly two distinct values count as boolean and are left out.
    """
    columns = numeric_columns(df)
    numbers = df.select(*[_present(df, c).cast("double").alias(c) for c in columns])

    def measures(c: str) -> Column:
        parts = [
            F.lit(c).alias("column_name"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min_val"),
            F.max(c).alias("max_val"),
        ]
        if approximate:
            parts += [
                F.percentile_approx(c, 0.5).alias("median"),
                F.approx_count_distinct(c).alias("distinct_values"),
            ]
        return F.struct(*parts)

    rows = numbers.agg(F.array(*[measures(c) for c in columns]).alias("_m")).select(
        F.inline("_m")
    )
    if not approximate:
        halves = exact_quantiles(numbers, columns, [0.5])
        rows = rows.join(
            halves.select(
                "column_name", "distinct_values", F.get("quantiles", F.lit(0)).alias("median")
            ),
            "column_name",
        )
    return rows.where(F.col("distinct_values") != 2).select(
        "column_name", "mean", "median", "std", "min_val", "max_val"
    )


def profile_roles(profile: DataFrame) -> DataFrame:
    """Role flags for the rows of :func:`profile_columns`.

    ``id`` is searched as a substring of the name, so ``total_paid`` can be an id too.
    """
    distinct, rows = F.col("unique_count"), F.col("row_count")
    number = F.col("kind").isin("numeric", "boolean")
    moment = F.col("kind") == "datetime"
    boolean = (F.col("kind") == "boolean") | ((F.col("kind") == "numeric") & (distinct == 2))
    is_id = F.when(
        F.lower("column_name").contains("id"), distinct > rows * 0.8
    ).otherwise(~number & (distinct == rows))
    return profile.select(
        "position",
        "column_name",
        "row_count",
        "unique_count",
        (number & ~boolean).alias("is_numeric"),
        moment.alias("is_datetime"),
        boolean.alias("is_boolean"),
        is_id.alias("is_id"),
        (~is_id & ~moment & (~number | boolean | (distinct <= 20))).alias("is_categorical"),
        ladder(distinct, [(10, "low"), (50, "medium")], "high", op="<=").alias("cardinality"),
    )


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The most frequent values of each column, NULL left out, ties by value."""
    chosen = df.select(*columns)
    return _most_frequent(value_counts(chosen), n).join(
        _names(chosen).select("position", "column_name"), "position"
    ).select("column_name", "rank", "value", F.col("n").alias("occurrences"))


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    ranked = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
    )


def profile_top_values(df: DataFrame, n: int = 10) -> DataFrame:
    """:func:`top_values` of the categorical columns."""
    counts = durable(value_counts(df))
    roles = profile_roles(profile_columns(df, samples=0, counts=counts)).where("is_categorical")
    return (
        _most_frequent(counts, n)
        .join(roles.select("position", "column_name"), "position")
        .select("column_name", "rank", "value", F.col("n").alias("occurrences"))
    )


def _listed(condition: Column, *order: Column) -> Column:
    """Names of the matching columns as an array; the column count bounds it."""
    entry = F.struct(*order, F.col("position"), F.col("column_name"))
    kept = F.sort_array(F.collect_list(F.when(condition, entry)))
    return F.transform(kept, lambda e: e["column_name"])


def profile_dataset(roles: DataFrame) -> DataFrame:
    """One row about the whole table, from :func:`profile_roles`."""
    number, is_id = F.col("is_numeric"), F.col("is_id")
    category, moment = F.col("is_categorical"), F.col("is_datetime")
    return roles.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        _listed(number & ~is_id).alias("numeric_columns"),
        _listed(category & ~is_id).alias("categorical_columns"),
        _listed(moment).alias("datetime_columns"),
        _listed(is_id).alias("id_columns"),
        (F.count_if(moment) > 0).alias("has_time_series"),
        _listed(
            category & ~is_id & F.col("cardinality").isin("low", "medium"),
            number.cast("int").alias("numeric_last"),
            F.col("unique_count"),
        ).alias("primary_dimensions"),
        _listed(number & ~is_id).alias("primary_metrics"),
        F.min(
            F.when(
                category & ~is_id & F.col("cardinality").isin("low", "medium"),
                F.struct(number.cast("int"), "unique_count", "position", "cardinality"),
            )
        )["cardinality"].alias("first_dimension_cardinality"),
    )


def insight_summary(dataset: DataFrame, numbers: DataFrame, intent: str | None = None) -> DataFrame:
    """A short text about the table from its dataset and numeric profiles."""
    # Closing note by intent.
    notes = {
        "ranking": "**Analysis Type**: Ranking/Top performers",
        "trend": "**Analysis Type**: Trend analysis over time",
        "comparison": "**Analysis Type**: Comparative analysis",
    }
    metrics, dimensions = F.col("primary_metrics"), F.col("primary_dimensions")
    note = F.lit(notes.get(intent)).cast("string")
    if intent == "ranking":
        note = F.when(F.size(metrics) > 0, note)
    named = dataset.withColumn("column_name", F.get(metrics, F.lit(0))).join(
        numbers.select("column_name", "mean", "min_val", "max_val"), "column_name", "left"
    )
    lines = F.array(
        F.concat(
            F.lit("**Dataset Overview**: "),
            F.format_number("row_count", 0),
            F.lit(" rows, "),
            F.col("column_count").cast("string"),
            F.lit(" columns"),
        ),
        F.when(
            F.size(metrics) > 0,
            F.concat(F.lit("**Key Metrics**: "), F.array_join(F.slice(metrics, 1, 3), ", ")),
        ),
        F.concat(
            F.lit("**"),
            F.col("column_name"),
            F.lit("**: Avg: "),
            F.format_number("mean", 2),
            F.lit(", Range: "),
            F.format_number("min_val", 2),
            F.lit(" - "),
            F.format_number("max_val", 2),
        ),
        F.when(
            F.size(dimensions) > 0,
            F.concat(F.lit("**Dimensions**: "), F.array_join(F.slice(dimensions, 1, 3), ", ")),
        ),
        F.when(
            F.col("has_time_series"),
            F.lit("**Time Period**: Data includes time-series information"),
        ),
        note,
    )
    return named.select(F.array_join(F.array_compact(lines), "\n\n").alias("summary"))
