"""The data under common charts, and rules that choose the charts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.operators.ordering import exact_quantiles

# A metric whose name holds one of these words is summed, others averaged.
ADDITIVE_WORDS = ["amount", "total", "sum", "revenue", "price", "value"]
CUMULATIVE_WORDS = ["total", "cumulative", "sum"]


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def _numbers(df: DataFrame, *metrics: str) -> DataFrame:
    """NaN taken as missing in the floating columns among ``metrics``."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(
        {m: F.when(~F.isnan(m), F.col(m)) for m in metrics if m in floating}
    )


def _total(metric: str) -> Column:
    """Sum in which a group without values counts as zero."""
    return F.coalesce(F.sum(metric), F.lit(0))


def top_n(df: DataFrame, dimension: str, metric: str, n: int = 10) -> DataFrame:
    """The groups with the largest sums, or the largest rows when both columns are one."""
    df = _numbers(df, metric)
    if dimension == metric:
        rest = [F.col(c) for c in df.columns if c != metric]
        return df.orderBy(F.desc_nulls_last(metric), *rest).limit(n)
    return (
        _present(df, [dimension])
        .groupBy(dimension)
        .agg(_total(metric).alias(metric))
        .orderBy(F.desc(metric), dimension)
        .limit(n)
    )


def group_agg(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Sum, mean or count of the metric per group, chosen by its name."""
    groups = _present(_numbers(df, metric), keys).groupBy(*keys)
    if metric in keys:
        return groups.agg(F.count("*").alias("count"))
    if any(word in metric.lower() for word in ADDITIVE_WORDS):
        return groups.agg(_total(metric).alias(metric))
    return groups.agg(F.avg(metric).alias(metric))


def pie_top(df: DataFrame, name: str, metric: str, n: int = 8) -> DataFrame:
    grouped = group_agg(df, [name], metric)
    value = "count" if metric == name else metric
    return grouped.orderBy(F.desc_nulls_last(value), name).limit(n)


def time_series(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """All rows in time order; further columns settle ties."""
    return df.orderBy(F.col(time).asc_nulls_last(), *[F.col(t) for t in ties])


def daily_series(df: DataFrame, time: str, metric: str) -> DataFrame:
    """One point per day, for tables with more rows than a line can show."""
    return (
        _present(_numbers(df, metric), [time])
        .groupBy(F.col(time).cast("date").alias("day"))
        .agg(_total(metric).alias(metric))
        .orderBy("day")
    )


def downsampled_series(
    df: DataFrame, time: str, metric: str, *ties: str, width: int = 800
) -> DataFrame:
    """The points a line of ``width`` pixels can show, at most four for each pixel column.

    The time span is cut into equal columns, and of each the first, last, least and largest point
    stay: drawn, the line covers the same pixels as all points would. One aggregation with partial
    states; nothing is sorted but the result. Points without time or value are left out. Columns:
    ``pixel``, the time, the metric and the ties.
    """
    columns = list(dict.fromkeys([time, metric, *ties]))
    points = _present(_numbers(df.select(*columns), metric), [time, metric])
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = points.agg(F.struct(F.min(at).alias("low"), F.max(at).alias("high"))).scalar()
    placed = (
        points.withColumn("_offset", (at - span["low"]).cast("decimal(38,0)"))
        .withColumn("_span", F.greatest(span["high"] - span["low"] + 1, F.lit(1)).cast("decimal(20,0)"))
        .withColumn("_width", F.lit(width).cast("decimal(10,0)"))
        .withColumn("pixel", F.expr("cast(_offset * _width div _span as int)"))
    )
    point = F.struct(*columns)
    order = F.struct(*dict.fromkeys([time, *ties, metric]))
    height = F.struct(*dict.fromkeys([metric, time, *ties]))
    # Of equal values the earliest stays, so the largest value needs its own order.
    earliest = F.struct(metric, (-at).alias("_t"), *ties)
    kept = placed.groupBy("pixel").agg(
        F.array(
            F.min_by(point, order),
            F.max_by(point, order),
            F.min_by(point, height),
            F.max_by(point, earliest),
        ).alias("_points")
    )
    return (
        kept.select("pixel", F.explode(F.array_distinct("_points")).alias("_p"))
        .select("pixel", "_p.*")
        .orderBy(time, *ties)
    )


def trend_pct_change(df: DataFrame, time: str, metric: str, *ties: str) -> DataFrame:
    """Change from the first to the last row in time, in percent; needs two rows."""
    df = _numbers(df, metric)
    at = F.struct(F.col(time).isNull().alias("late"), *[F.col(c) for c in (time, *ties)])
    ends = df.agg(
        F.min_by(F.struct(metric), at)[metric].alias("first_value"),
        F.max_by(F.struct(metric), at)[metric].alias("last_value"),
        F.count("*").alias("_rows"),
    )
    first, last = F.col("first_value").cast("double"), F.col("last_value").cast("double")
    change = (last - first) / F.nullif(first, F.lit(0.0)) * 100
    return ends.where(F.col("_rows") > 1).select(
        "first_value",
        "last_value",
        change.alias("pct_change"),
        F.when(change > 0, "up").when(change <= 0, "down").alias("direction"),
    )


def histogram(df: DataFrame, metric: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value, with the mean."""
    value = F.col(metric).cast("double")
    numbers = df.select(value.alias("v")).where(value.isNotNull() & ~F.isnan(value))
    facts = numbers.agg(
        F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    ).scalar()
    low, high = facts["lo"], facts["hi"]
    # Bins are half open; the largest value belongs to the last one.
    inside = F.floor((F.col("v") - low) * bins / F.nullif(high - low, F.lit(0.0)))
    bin_number = F.least(F.coalesce(inside, F.lit(0)), F.lit(bins - 1))
    width = (high - low) / bins
    return (
        numbers.groupBy(bin_number.cast("int").alias("bin"))
        .agg(F.count("*").alias("row_count"))
        .select(
            "bin",
            (low + width * F.col("bin")).alias("bin_start"),
            (low + width * (F.col("bin") + 1)).alias("bin_end"),
            "row_count",
            facts["mean"].alias("mean"),
        )
    )


def box_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum, exact, one row per metric."""
    parts = ["minimum", "lower_quartile", "median", "upper_quartile", "maximum"]
    quantiles = exact_quantiles(_numbers(df, *metrics), metrics, [0, 0.25, 0.5, 0.75, 1])
    return quantiles.select(
        "column_name", *[F.get("quantiles", F.lit(i)).alias(p) for i, p in enumerate(parts)]
    )


_MOMENTS = ("n", "mean_x", "mean_y", "co", "xx", "yy", "low_x", "high_x", "low_y", "high_y")


def _co_moments(x: np.ndarray) -> np.ndarray:
    """Moments of all pairs of columns over the rows that have both: (moment, column, column).

    For each pair the count, the means, the sums of products about the means, and the extremes.
    """
    known = ~np.isnan(x)
    centre = np.array([c[k].mean() if k.any() else 0.0 for c, k in zip(x.T, known.T)])
    centre[~np.isfinite(centre)] = 0.0
    near, mask = np.where(known, x - centre, 0.0), known.astype(float)
    n = mask.T @ mask
    mean = np.divide(near.T @ mask, n, out=np.zeros_like(n), where=n > 0)
    square = (near**2).T @ mask - n * mean**2
    low, high = np.empty_like(n), np.empty_like(n)
    for j, own in enumerate(known.T):
        rows = x if own.all() else x[own]
        low[:, j] = np.fmin.reduce(rows, axis=0, initial=np.inf)
        high[:, j] = np.fmax.reduce(rows, axis=0, initial=-np.inf)
    means = mean + centre[:, None]
    co = near.T @ near - n * mean * mean.T
    return np.stack([n, means, means.T, co, square, square.T, low, high, low.T, high.T])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    gap_x, gap_y = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    return np.stack(
        [
            n,
            a[1] + gap_x * share,
            a[2] + gap_y * share,
            a[3] + b[3] + gap_x * gap_y * both,
            a[4] + b[4] + gap_x**2 * both,
            a[5] + b[5] + gap_y**2 * both,
            np.minimum(a[6], b[6]),
            np.maximum(a[7], b[7]),
            np.minimum(a[8], b[8]),
            np.maximum(a[9], b[9]),
        ]
    )


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mergeable moments of all pairs of columns, one row for each pair and task.

    Columns: ``x`` and ``y`` (positions in ``columns``, x <= y) and the moments. Rows that lack either
    value are left out of a pair only. States of several tables, or of the parts of one, are
    put together by :func:`merge_co_moments`.
    """
    names = list(columns)
    values = _numbers(df.select(*[F.col(c).cast("double").alias(c) for c in names]), *names)
    rows, cols = np.triu_indices(len(names))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            own = _co_moments(x.astype(float))
            state = own if state is None else _merged(state, own)
        if state is not None:
            held = {name: values[rows, cols] for name, values in zip(_MOMENTS, state)}
            yield pa.RecordBatch.from_pydict(
                {"x": rows.astype(np.int32), "y": cols.astype(np.int32), **held}
            )

    fields = ", ".join(f"{name} double" for name in _MOMENTS)
    return values.mapInArrow(gather, f"x int, y int, {fields}")


def merge_co_moments(states: DataFrame) -> DataFrame:
    """One state for each pair. A pair has one row a task, so its window is small."""
    pair = Window.partitionBy("x", "y")
    states = states.where(F.col("n") > 0)
    total = F.sum("n").over(pair)
    gaps = states.withColumns(
        {side: F.sum(F.col("n") * F.col(side)).over(pair) / total for side in ("mean_x", "mean_y")}
        | {f"_{side}": F.col(side) for side in ("mean_x", "mean_y")}
    )
    gap_x, gap_y = (F.col(f"_{side}") - F.col(side) for side in ("mean_x", "mean_y"))
    return gaps.groupBy("x", "y").agg(
        F.sum("n").alias("n"),
        F.first("mean_x").alias("mean_x"),
        F.first("mean_y").alias("mean_y"),
        F.sum(F.col("co") + F.col("n") * gap_x * gap_y).alias("co"),
        F.sum(F.col("xx") + F.col("n") * gap_x * gap_x).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * gap_y * gap_y).alias("yy"),
        *[F.min(c).alias(c) for c in ("low_x", "low_y")],
        *[F.max(c).alias(c) for c in ("high_x", "high_y")],
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns.

    Rows missing either value are left out for that pair only; a column that is constant over the
    rows of a pair has no correlation. The table is read once; each task sends one state.
    """
    return correlations(co_moments(df, columns), columns)


def correlations(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`correlation_matrix` from the states of :func:`co_moments`."""
    # Of a constant column, rounding can leave a correlation that means nothing.
    varies = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    value = F.when(varies, F.try_divide("co", F.sqrt("xx") * F.sqrt("yy")))
    found = merge_co_moments(states).select("x", "y", value.alias("correlation"))
    names, width = F.array(*map(F.lit, columns)), len(columns)
    i, j = F.expr(f"cast(id div {width} as int)"), (F.col("id") % width).cast("int")
    pairs = states.sparkSession.range(width * width, numPartitions=1).select(
        F.get(names, i).alias("column_x"),
        F.get(names, j).alias("column_y"),
        F.least(i, j).alias("x"),
        F.greatest(i, j).alias("y"),
    )
    # One row for each pair of columns.
    return pairs.join(F.broadcast(found), ["x", "y"], "left").drop("x", "y")


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The rows themselves, cut to the drawn columns."""
    return df.select(*[c for c in (x, y, color) if c])


def sampled_scatter(
    df: DataFrame, x: str, y: str, color: str | None = None, key: Sequence[str] = (), n: int = 1000
) -> DataFrame:
    """At most ``n`` points a colour: those with the smallest hash of their key.

    The hash is the md5 of the key columns (or of the drawn ones), so every run, on any
    partitioning, picks the same rows, and the picks of parts of a table can be picked from
    again. Tasks keep ``n`` rows a colour before anything is shuffled.
    """
    columns = list(dict.fromkeys(c for c in (x, y, color) if c))
    keys = list(key) or columns
    hashed = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]))
    group = [F.col(color)] if color else [F.lit(1)]
    first = Window.partitionBy(*group).orderBy("_hash", *columns)
    return (
        df.select(*columns, hashed.alias("_hash"))
        .withColumn("_number", F.row_number().over(first))
        .where(F.col("_number") <= n)
        .select(*columns)
    )


def _chart(kind: str, title: Column, x: Column, y: Column, color: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("chart_type"),
        x.alias("x"),
        y.alias("y"),
        (none if color is None else color).alias("color"),
        title.alias("title"),
    )


def _as_rows(dataset: DataFrame, charts: Column) -> DataFrame:
    return dataset.select(F.posexplode(charts).alias("_p", "_c")).select(
        (F.col("_p") + 1).alias("rank"), "_c.*"
    )


def recommend(dataset: DataFrame, limit: int = 4) -> DataFrame:
    """Charts worth drawing for a dataset profile, best first.

    The intent of a question does not change the choice.
    """
    none = F.lit(None).cast("string")
    metrics, dims = F.col("primary_metrics"), F.col("primary_dimensions")
    ids, times = F.col("id_columns"), F.col("datetime_columns")
    metric, metric2 = F.get(metrics, F.lit(0)), F.get(metrics, F.lit(1))
    dim, dim2, time = F.get(dims, F.lit(0)), F.get(dims, F.lit(1)), F.get(times, F.lit(0))
    first_id = F.get(ids, F.lit(0))
    ranked_dim = F.when((dim == metric) & dim2.isNotNull(), dim2).otherwise(dim)
    ranked = ranked_dim.isNotNull() & metric.isNotNull() & (ranked_dim != metric)
    timed = time.isNotNull() & metric.isNotNull()
    cumulative = F.lit(False)
    for word in CUMULATIVE_WORDS:
        cumulative = cumulative | F.lower(metric).contains(word)
    charts = F.array_compact(
        F.array(
            F.when(timed, _chart("line", F.concat(metric, F.lit(" Over Time")), time, metric, dim)),
            F.when(
                timed & cumulative,
                _chart("area", F.concat(F.lit("Cumulative "), metric), time, metric),
            ),
            F.when(
                ranked,
                _chart(
                    "bar",
                    F.concat(F.lit("Top "), ranked_dim, F.lit(" by "), metric),
                    metric,
                    ranked_dim,
                ),
            ),
            F.when(
                ranked & dim2.isNotNull(),
                _chart(
                    "grouped_bar",
                    F.concat(metric, F.lit(" by "), dim, F.lit(" and "), dim2),
                    dim,
                    metric,
                    dim2,
                ),
            ),
            F.when(
                metric.isNotNull(),
                _chart("histogram", F.concat(F.lit("Distribution of "), metric), metric, none),
            ),
            F.when(
                dim.isNotNull()
                & metric.isNotNull()
                & (F.col("first_dimension_cardinality") == "low"),
                _chart("pie", F.concat(metric, F.lit(" Distribution by "), dim), dim, metric),
            ),
            F.when(
                metric2.isNotNull(),
                _chart("scatter", F.concat(metric2, F.lit(" vs "), metric), metric, metric2, dim),
            ),
        )
    )
    by_id = F.array_compact(
        F.array(
            F.when(
                first_id.isNotNull() & metric.isNotNull(),
                _chart(
                    "bar",
                    F.concat(F.lit("Top "), first_id, F.lit(" by "), metric),
                    metric,
                    first_id,
                ),
            )
        )
    )
    chosen = F.when(F.size(charts) > 0, F.array_distinct(charts)).otherwise(by_id)
    return _as_rows(dataset, F.slice(chosen, 1, limit))


def fallback(dataset: DataFrame) -> DataFrame:
    """The simpler rule set: the first case that applies."""
    none = F.lit(None).cast("string")
    metrics, dims = F.col("primary_metrics"), F.col("primary_dimensions")
    m1, m2, m3 = (F.get(metrics, F.lit(i)) for i in range(3))
    dim, time = F.get(dims, F.lit(0)), F.get(F.col("datetime_columns"), F.lit(0))
    versus = F.concat(m2, F.lit(" vs "), m1)
    return _as_rows(
        dataset,
        F.when(
            dim.isNotNull() & m1.isNotNull(),
            F.array(_chart("bar", F.concat(m1, F.lit(" by "), dim), dim, m1)),
        )
        .when(
            time.isNotNull() & m1.isNotNull(),
            F.array(_chart("line", F.concat(m1, F.lit(" Over Time")), time, m1)),
        )
        .when(
            m3.isNotNull(),
            F.array(
                _chart("scatter", F.concat(versus, F.lit(" (colored by "), m3, F.lit(")")), m1, m2, m3),
                _chart("heatmap", F.lit("Correlation Matrix - All Numeric Columns"), none, none),
            ),
        )
        .when(m2.isNotNull(), F.array(_chart("scatter", versus, m1, m2)))
        .when(
            m1.isNotNull(),
            F.array(
                _chart("histogram", F.concat(F.lit("Distribution of "), m1), m1, none),
                _chart("box", F.concat(F.lit("Statistical Summary of "), m1), none, m1),
            ),
        ),
    )
