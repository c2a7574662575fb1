"""Profiles from merged sketches against exact measures, within the promised errors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martwright.operators import sketches
from martwright.sources import tables


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(4)
    n = 40_000
    skewed = rng.zipf(1.5, n).clip(max=10**9)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "price": np.where(rng.random(n) < 0.1, np.nan, rng.exponential(40, n) + 1e6),
            "kind": np.array(list("abcde"))[rng.integers(0, 5, n)],
            "word": [f"w{v}" for v in skewed],
            "few": rng.integers(0, 9, n),
        }
    )


@pytest.fixture(scope="module")
def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("kind", F.when(F.col("kind") != "e", F.col("kind")))


@pytest.fixture(scope="module")
def found(frame, spark, tmp_path_factory):
    store = sketches.SketchStore(spark, str(tmp_path_factory.mktemp("s") / "store"))
    for i in range(5):
        assert store.update({f"batch {i}": frame.where(f"id % 5 = {i}")}) == {f"batch {i}"}
    return {r.column_name: r for r in store.profile(5).collect()}


def test_counts_and_moments_are_exact(found, pdf):
    for c in ("id", "price", "few"):
        r, x = found[c], pdf[c].dropna()
        assert (r.row_count, r.null_count) == (len(pdf), pdf[c].isna().sum())
        assert (r.min_val, r.max_val) == (x.min(), x.max())
        assert r.mean == pytest.approx(x.mean(), rel=1e-12)
        assert r["std"] == pytest.approx(x.std(), rel=1e-6)
    assert found["kind"].null_count == (pdf["kind"] == "e").sum()
    assert found["kind"].mean is None and found["kind"].kind == "other"


def test_distinct_counts_and_quantiles_are_within_their_errors(found, pdf):
    for c in ("id", "word", "few", "price"):
        assert found[c].unique_estimate == pytest.approx(pdf[c].nunique(), rel=0.05)
    for c in ("id", "price"):
        x = np.sort(pdf[c].dropna())
        for p, name in ((0.25, "lower_quartile"), (0.5, "median"), (0.75, "upper_quartile")):
            rank = np.searchsorted(x, found[c][f"{name}_estimate"]) / len(x)
            assert abs(rank - p) < 0.03


def test_frequent_values(found, pdf):
    assert [(e["item"], e["count"]) for e in found["few"].top_values] == [
        (str(v), n) for v, n in pdf["few"].value_counts().items()
    ][:5]
    words = pdf["word"].value_counts()
    for e in found["word"].top_values[:3]:
        assert abs(e["count"] - words[e["item"]]) <= 3.5 / sketches.TRACKED * len(pdf)
    assert {e["item"] for e in found["kind"].top_values} == set("abcd")


def test_more_distinct_values_than_are_tracked(spark, monkeypatch):
    monkeypatch.setattr(sketches, "TRACKED", 64)
    df = spark.range(20_000).selectExpr("if(id % 4 = 0, 'hot', cast(id as string)) as v")
    row = sketches.profile(sketches.merge(sketches.sketch(df.repartition(4))), 1).first()
    top = row.top_values[0]
    assert top["item"] == "hot" and abs(top["count"] - 5000) <= 3.5 / 64 * 20_000


def test_an_appended_table_reads_its_new_months_only(spark, tmp_path, monkeypatch):
    def days(rows):
        return spark.createDataFrame(
            [(i, dt.datetime(2019, m, 5), v) for i, m, v in rows], "id int, at timestamp, v double"
        )

    path, store = str(tmp_path / "t"), sketches.SketchStore(spark, str(tmp_path / "s"))
    rows = [(1, 1, 1.0), (2, 1, 3.0), (3, 2, 5.0), (4, 3, float("nan"))]
    tables.sink_months(days(rows), path, "at")
    assert len(store.update(tables.month_parts(spark, path), keep=False)) == 3
    assert store.update(tables.month_parts(spark, path), keep=False) == set()
    # One month grows, one is new, one is gone.
    rows = [(1, 1, 1.0), (2, 1, 3.0), (3, 2, 5.0), (5, 2, 7.0), (6, 4, None)]
    tables.sink_months(days(rows), path, "at")
    new = store.update(tables.month_parts(spark, path), keep=False)
    assert sorted(p.rsplit("=", 1)[1] for p in new) == ["2019-02", "2019-04"]
    assert len(store.parts()) == 3
    row = {r.column_name: r for r in store.profile().collect()}["v"]
    assert (row.row_count, row.null_count, row.mean, row.max_val) == (5, 1, 4.0, 7.0)


def test_parts_without_rows_or_values(spark, tmp_path):
    store = sketches.SketchStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no sketches"):
        store.profile()
    df = spark.range(3).select("id", F.lit(None).cast("double").alias("x"))
    assert store.update({"none": df.limit(0)}) == {"none"} and store.profile().count() == 0
    store.update({"a": df, "b": df.limit(0)})
    row = {r.column_name: r for r in store.profile().collect()}["x"]
    assert (row.row_count, row.null_count, row.median_estimate, row.mean) == (3, 3, None, None)
    assert row.top_values == [] and row.unique_estimate == 0
