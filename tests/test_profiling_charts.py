import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martwright.operators import charts, profiling


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 300
    return pd.DataFrame(
        {
            "order_id": np.arange(n),
            "flag": rng.integers(0, 2, n),
            "total_paid": np.round(rng.normal(100, 30, n), 2),
            "stars": rng.integers(1, 6, n),
            "twenty": np.arange(n) % 20,
            "twentyone": np.arange(n) % 21,
            "city": rng.choice(["rio", "recife", "natal", None], n),
            "unique_text": [f"t{i}" for i in range(n)],
            "day": pd.date_range("2018-01-01", periods=n),
            "few": [1.5, float("nan"), 2.5] * (n // 3),
        }
    )


@pytest.fixture(scope="module")
def df(spark, pdf):
    frame = spark.createDataFrame(pdf.drop(columns="city")).join(
        spark.createDataFrame(
            [(int(i), c) for i, c in zip(pdf["order_id"], pdf["city"])], "order_id long, city string"
        ),
        "order_id",
    )
    return frame.select(*pdf.columns)


def roles(df):
    profile = profiling.profile_roles(profiling.profile_columns(df))
    return {r.column_name: r for r in profile.collect()}


def test_profile_columns_equals_pandas(df, pdf):
    got = {r.column_name: r for r in profiling.profile_columns(df).collect()}
    assert [got[c].position for c in pdf.columns] == list(range(len(pdf.columns)))
    for c in pdf.columns:
        assert got[c].unique_count == pdf[c].nunique(), c
        assert got[c].null_count == pdf[c].isnull().sum(), c
        assert got[c].null_percentage == pytest.approx(pdf[c].isnull().mean() * 100)
        assert len(got[c].sample_values) == min(5, pdf[c].nunique())


def test_approximate_profile_is_near(df, pdf):
    got = {r.column_name: r for r in profiling.profile_columns(df, approximate=True).collect()}
    for c in pdf.columns:
        assert got[c].unique_count == pytest.approx(pdf[c].nunique(), rel=0.15), c
        assert got[c].null_count == pdf[c].isnull().sum(), c


def test_profile_numeric_equals_pandas(df, pdf):
    got = {r.column_name: r for r in profiling.profile_numeric(df).collect()}
    # Two distinct values make a boolean, with or without gaps.
    assert set(got) == {"order_id", "total_paid", "stars", "twenty", "twentyone"}
    for c, r in got.items():
        want = pdf[c].agg(["mean", "median", "std", "min", "max"])
        assert [r["mean"], r["median"], r["std"], r["min_val"], r["max_val"]] == pytest.approx(list(want))


def test_roles(df):
    got = roles(df)
    assert got["order_id"].is_id and got["unique_text"].is_id
    # The name holds "id" inside "paid".
    assert got["total_paid"].is_id
    assert got["flag"].is_boolean and not got["flag"].is_numeric and got["flag"].is_categorical
    assert got["twenty"].is_categorical and not got["twentyone"].is_categorical
    assert got["twenty"].cardinality == "medium" and got["total_paid"].cardinality == "high"
    # Not numeric and all distinct: the id rule does not look at the type any further.
    assert got["day"].is_datetime and got["day"].is_id and not got["day"].is_categorical


def test_dataset_profile(df):
    frame = df.drop("total_paid", "unique_text")
    row = profiling.profile_dataset(profiling.profile_roles(profiling.profile_columns(frame))).first()
    assert (row.row_count, row.column_count, row.has_time_series) == (300, 8, True)
    assert row.numeric_columns == ["stars", "twenty", "twentyone"]
    assert row.categorical_columns == ["flag", "stars", "twenty", "city", "few"]
    assert row.primary_dimensions == ["flag", "few", "city", "stars", "twenty"]
    assert row.first_dimension_cardinality == "low"


def test_top_values_equal_pandas(df, pdf):
    got = profiling.top_values(df, ["city"]).orderBy("rank").collect()
    want = pdf["city"].value_counts()
    assert [(r.value, r.occurrences) for r in got] == list(want.items())


def test_insights(df):
    frame = df.drop("unique_text")
    data = profiling.profile_dataset(profiling.profile_roles(profiling.profile_columns(frame)))
    text = profiling.insight_summary(data, profiling.profile_numeric(frame), "ranking").first().summary
    assert text.split("\n\n")[0] == "**Dataset Overview**: 300 rows, 9 columns"
    assert "**Key Metrics**: stars, twenty, twentyone" in text
    assert "**Analysis Type**: Ranking/Top performers" in text
    silent = profiling.insight_summary(data, profiling.profile_numeric(frame)).first().summary
    assert "Analysis Type" not in silent


def test_top_n(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", 5.0), ("a", 4.0), (None, 99.0), ("c", None)], "k string, v double"
    )
    assert [tuple(r) for r in charts.top_n(df, "k", "v").collect()] == [("a", 5.0), ("b", 5.0), ("c", 0.0)]
    assert [r.v for r in charts.top_n(df, "v", "v", 2).collect()] == [99.0, 5.0]


def test_group_agg_rules(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 1.0), ("a", "x", 3.0, 3.0), ("b", None, 5.0, 5.0)],
        "k string, l string, order_total double, stars double",
    )
    assert rows(charts.group_agg(df, ["k"], "order_total")) == [("a", 4.0), ("b", 5.0)]
    assert rows(charts.group_agg(df, ["k"], "stars")) == [("a", 2.0), ("b", 5.0)]
    assert rows(charts.group_agg(df, ["k", "l"], "stars")) == [("a", "x", 2.0)]
    assert rows(charts.group_agg(df, ["k"], "k")) == [("a", 2), ("b", 1)]
    assert charts.pie_top(df, "k", "order_total", 1).collect()[0].k == "b"


def test_trend(spark):
    schema = "t timestamp_ntz, id int, v double"
    at = lambda d: dt.datetime(2018, 1, d)
    up = spark.createDataFrame([(at(2), 2, 30.0), (at(1), 1, 20.0), (at(2), 3, 25.0)], schema)
    row = charts.trend_pct_change(up, "t", "v", "id").first()
    assert (row.first_value, row.last_value, row.pct_change, row.direction) == (20.0, 25.0, 25.0, "up")
    assert charts.trend_pct_change(up.limit(1), "t", "v", "id").count() == 0
    zero = spark.createDataFrame([(at(1), 1, 0.0), (at(2), 2, 1.0)], schema)
    assert charts.trend_pct_change(zero, "t", "v", "id").first().pct_change is None


def test_daily_series(df, pdf):
    got = charts.daily_series(df, "day", "stars").collect()
    assert [r.stars for r in got] == list(pdf["stars"])


def test_histogram_counts(df, pdf):
    got = {r.bin: r for r in charts.histogram(df, "total_paid").collect()}
    counts, edges = np.histogram(pdf["total_paid"], bins=20)
    assert {b: c for b, c in enumerate(counts) if c} == {b: r.row_count for b, r in got.items()}
    assert got[0].bin_start == pytest.approx(edges[0]) and got[19].bin_end == pytest.approx(edges[-1])
    constant = charts.histogram(df.select(F.lit(3).alias("v")), "v").collect()
    assert [(r.bin, r.row_count) for r in constant] == [(0, 300)]


def test_box(df, pdf):
    row = charts.box_summary(df, ["total_paid"]).first()
    assert list(row[1:]) == pytest.approx(list(np.quantile(pdf["total_paid"], [0, 0.25, 0.5, 0.75, 1])))


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (500, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"] * 0.5
    pdf["k"] = 2.0
    frame = spark.createDataFrame(pdf)
    # Gaps leave a row out of its own pairs only.
    frame = frame.withColumn("c", F.when(F.col("c") > 1e6 - 1, F.col("c"))).repartition(7)
    pdf.loc[pdf["c"] <= 1e6 - 1, "c"] = None
    want = pdf.corr()
    got = charts.correlation_matrix(frame, list(pdf.columns)).collect()
    assert len(got) == 25
    for r in got:
        if r.correlation is None:
            assert "k" in (r.column_x, r.column_y)
        else:
            assert r.correlation == pytest.approx(want.loc[r.column_x, r.column_y], abs=1e-6)


def dataset(spark, metrics=(), dims=(), times=(), ids=(), low=True):
    return spark.createDataFrame(
        [(list(metrics), list(dims), list(times), list(ids), "low" if low else "medium")],
        "primary_metrics array<string>, primary_dimensions array<string>, "
        "datetime_columns array<string>, id_columns array<string>, first_dimension_cardinality string",
    )


def kinds(df):
    return [(r.rank, r.chart_type, r.x, r.y, r.color) for r in df.orderBy("rank").collect()]


def test_recommend(spark):
    full = dataset(spark, ["order_total", "stars"], ["city", "state"], ["day"], ["order_id"])
    assert kinds(charts.recommend(full)) == [
        (1, "line", "day", "order_total", "city"),
        (2, "area", "day", "order_total", None),
        (3, "bar", "order_total", "city", None),
        (4, "grouped_bar", "city", "order_total", "state"),
    ]
    assert kinds(charts.recommend(dataset(spark, ["m", "n"], ["d"]))) == [
        (1, "bar", "m", "d", None),
        (2, "histogram", "m", None, None),
        (3, "pie", "d", "m", None),
        (4, "scatter", "m", "n", "d"),
    ]
    assert kinds(charts.recommend(dataset(spark, ["m"], ["m"]))) == [
        (1, "histogram", "m", None, None),
        (2, "pie", "m", "m", None),
    ]
    assert kinds(charts.recommend(dataset(spark, ["m"], ["m", "d"], low=False))) == [
        (1, "bar", "m", "d", None),
        (2, "grouped_bar", "m", "m", "d"),
        (3, "histogram", "m", None, None),
    ]
    assert kinds(charts.recommend(dataset(spark, [], ["d"], ["t"]))) == []


def test_fallback(spark):
    assert kinds(charts.fallback(dataset(spark, ["m"], ["d"], ["t"]))) == [(1, "bar", "d", "m", None)]
    assert kinds(charts.fallback(dataset(spark, ["m"], [], ["t"]))) == [(1, "line", "t", "m", None)]
    assert kinds(charts.fallback(dataset(spark, ["a", "b", "c"]))) == [
        (1, "scatter", "a", "b", "c"),
        (2, "heatmap", None, None, None),
    ]
    assert kinds(charts.fallback(dataset(spark, ["a", "b"]))) == [(1, "scatter", "a", "b", None)]
    assert kinds(charts.fallback(dataset(spark, ["a"]))) == [
        (1, "histogram", "a", None, None),
        (2, "box", None, "a", None),
    ]
    assert kinds(charts.fallback(dataset(spark))) == []


def test_nan_is_missing_in_every_chart(spark):
    nan = float("nan")
    rows = [("a", 1.0, 2.0), ("a", nan, 1.0), ("b", 5.0, 4.0), ("c", nan, nan), ("b", 2.0, 3.0)]
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "t int, k string, value double, rate double"
    )
    assert charts.top_n(frame, "k", "value").collect()[0]["k"] == "b"
    assert [tuple(r) for r in charts.pie_top(frame, "k", "value").collect()] == [
        ("b", 7.0), ("a", 1.0), ("c", 0.0),
    ]
    rates = {r["k"]: r["rate"] for r in charts.group_agg(frame, ["k"], "rate").collect()}
    assert rates == {"a": 1.5, "b": 3.5, "c": None}
    box = charts.box_summary(frame, ["value"]).first()
    assert (box["minimum"], box["median"], box["maximum"]) == (1.0, 2.0, 5.0)
    backwards = frame.where("t in (0, 1)")
    trend = charts.trend_pct_change(backwards, "t", "value").first()
    assert trend["last_value"] is None and trend["direction"] is None
    cells = charts.correlation_matrix(frame, ["value", "rate"]).collect()
    known = frame.toPandas()[["value", "rate"]].corr()
    for r in cells:
        assert abs(r["correlation"] - known.loc[r["column_x"], r["column_y"]]) < 1e-12


# Bounded chart data


def test_downsampled_series_keeps_ends_and_extremes(spark):
    rng = np.random.default_rng(5)
    points = [(int(i), float(v)) for i, v in enumerate(rng.normal(size=3000))]
    points += [(1500, 99.0), (1501, -99.0), (1502, 99.0), (None, 500.0), (7, None), (8, float("nan"))]
    frame = spark.createDataFrame(
        [(None if t is None else dt.datetime.fromtimestamp(1_500_000_000 + 60 * t), v, n) for n, (t, v) in enumerate(points)],
        "at timestamp, v double, id int",
    ).repartition(7)
    drawn = charts.downsampled_series(frame, "at", "v", "id", width=50)
    kept = drawn.collect()
    assert len(kept) <= 200 and {r.pixel for r in kept} == set(range(50))
    assert [r["at"] for r in kept] == sorted(r["at"] for r in kept)
    whole = frame.where("at is not null and v is not null and not isnan(v)")
    for end in ("min(at)", "max(at)", "min(v)", "max(v)"):
        assert drawn.selectExpr(end).first()[0] == whole.selectExpr(end).first()[0]
    assert [r.id for r in kept if r.v == 99.0] == [3000]
    assert charts.downsampled_series(frame.limit(0), "at", "v").count() == 0
    one = charts.downsampled_series(frame.where("id = 5"), "at", "v", width=10).collect()
    assert [(r.pixel, r.v) for r in one] == [(0, points[5][1])]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort ") == 1 and "Window" not in plan


def test_sampled_scatter_is_the_same_on_every_run(spark):
    frame = spark.range(3000).selectExpr(
        "id", "id % 50 as x", "id % 31 as y", "if(id % 3 = 0, null, if(id < 40, 'few', 'many')) as c"
    )
    picks = [
        sorted(map(tuple, charts.sampled_scatter(frame.repartition(n), "x", "y", "c", ["id"], 20).collect()), key=repr)
        for n in (1, 9)
    ]
    assert picks[0] == picks[1]
    counts = {c: sum(p[2] == c for p in picks[0]) for c in (None, "few", "many")}
    assert counts == {None: 20, "few": 20, "many": 20}
    assert charts.sampled_scatter(frame, "x", "y", n=15).count() == 15


def test_correlations_of_parts_equal_those_of_the_whole(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * [1, 1e-3, 1e6, 1] + [0, 1e6, -1e9, 0]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=400)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:5, 1] = np.nan
    frame = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).withColumn("e", F.lit(3.5))
    names = list("abcde")
    parts = [charts.co_moments(frame.where(c), names) for c in ("a > 0", "not (a > 0) or a is null")]
    merged = charts.correlations(parts[0].unionByName(parts[1]), names)
    got = {(r.column_x, r.column_y): r.correlation for r in merged.collect()}
    want = frame.toPandas().corr()
    for a in names:
        for b in names:
            if "e" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want[a][b], abs=1e-6)
    empty = charts.correlation_matrix(frame.limit(0), names).collect()
    assert len(empty) == 25 and all(r.correlation is None for r in empty)
