import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martwright.operators import ordering
from martwright.operators.ordering import exact_quantiles, ntile_scores, running_total


def test_running_total_equals_window(spark):
    # One group holds most rows and all its order keys are equal but for the id.
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("g"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 11).alias("k"),
        (F.col("id") % 13).alias("w"),
    )
    got = running_total(df, ["g"], [F.col("k"), F.col("id")], "t", F.col("w"))
    window = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("t", F.sum("w").over(window))
    assert got.exceptAll(want).count() == 0
    assert got.count() == 5000


def test_running_total_spreads_a_hot_group(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select("id", F.lit("one").alias("g"))
        numbered = running_total(df, ["g"], [F.col("id")], "n")
        assert [r.n - r.id for r in numbered.collect()] == [1] * 4000
        ranged = df.repartitionByRange("g", "id").withColumn("p", F.spark_partition_id())
        assert ranged.groupBy("p").count().agg(F.max("count")).first()[0] < 1200
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 7, 23, 400])
def test_ntile_equals_window_ntile(spark, size):
    df = spark.range(size).select(
        F.col("id").cast("string").alias("key"),
        F.when(F.col("id") % 9 != 4, F.col("id") % 6).cast("int").alias("a"),
        F.lit(1).alias("same"),
        (F.col("id") * 37 % 101).cast("decimal(18,2)").alias("b"),
    )
    got = ntile_scores(df, "key", {"x": ("a", True), "y": ("b", False), "z": ("same", True)})
    tie = F.md5("key")
    want = df.select(
        "key",
        F.ntile(5).over(Window.orderBy(F.asc_nulls_last("a"), tie)).alias("x"),
        F.ntile(5).over(Window.orderBy(F.desc_nulls_first("b"), tie)).alias("y"),
        F.ntile(5).over(Window.orderBy(tie)).alias("z"),
    )
    assert got.count() == size
    assert got.select("key", "x", "y", "z").exceptAll(want).count() == 0


def test_ntile_puts_null_first_when_descending(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "key string, v int")
    got = {r.key: (r.up, r.down) for r in ntile_scores(df, "key", {"up": ("v", True), "down": ("v", False)}).collect()}
    assert got == {"a": (1, 3), "b": (3, 1), "c": (2, 2)}


def test_ntile_ranks_only_ties_at_an_end(spark, monkeypatch):
    """Distinct values are numbered, and of the rows only those with a value that a tile ends in."""
    numbered = []

    def watched(df, *args):
        numbered.append(df.count())
        return running_total(df, *args)

    monkeypatch.setattr(ordering, "running_total", watched)
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("key"),
        F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("a"),
    )
    got = ordering.ntile_scores(df, "key", {"x": ("a", True)})
    want = df.select("key", F.ntile(5).over(Window.orderBy("a", F.md5("key"))).alias("x"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert numbered == [2001, 1000]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.exponential(50, 2000), 1)
    values[:700] = 12.5
    frame = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "a double, b double")
    probabilities = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    got = {r.column_name: r for r in exact_quantiles(frame, ["a", "b"], probabilities).collect()}
    assert np.allclose(got["a"].quantiles, np.quantile(values, probabilities))
    assert np.allclose(got["b"].quantiles, np.quantile(np.arange(2000.0), probabilities))
    assert got["a"].distinct_values == len(set(values))
