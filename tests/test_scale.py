"""Plans: pruned scans, no cross joins, no one-task windows, joins split under skew."""

import contextlib
import io
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from martwright import session
from martwright.operators import profiling, vectors
from martwright.plans import core, maintain
from martwright.plans.queries import Inputs, all_queries

from conftest import SAMPLE

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

def plan_of(df, mode=None):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    """fact_orders fact_order_lines fact_payments fact_reviews fact_closed_deals bridge_product_seller
    fact_product_daily_metrics agg_daily_sales order_details_wide agg_customer_performance
    agg_customer_churn_risk agg_customer_repurchase_metrics agg_seller_performance
    agg_seller_health_scorecard agg_product_quality_metrics agg_marketing_channel_performance
    mql_details_wide""".split(),
)
def test_models_have_no_cross_join_and_no_python(spark, name):
    plan = plan_of(all_queries()[name](spark, SAMPLE))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert word not in plan, word
    # Rows meet in one task for global maxima and counts only, so never under a window.
    singles = plan.count("Exchange SinglePartition")
    assert singles <= plan.count("Subquery ") * 2


def test_no_window_without_partitions(spark):
    for name in ("customer_segments", "dim_location"):
        plan = plan_of(all_queries()[name](spark, SAMPLE))
        assert "Exchange SinglePartition" not in re.sub(r"Subquery.*", "", plan, flags=re.S)


def test_daily_sales_reads_only_what_it_needs(spark):
    plan = plan_of(all_queries()["agg_daily_sales"](spark, SAMPLE))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?/(\w+)\.parquet", plan)
    read = {table: {re.sub(r"#\d+L?", "", c) for c in columns.split(",")} for columns, table in scans}
    assert read["lineitem"] <= {"l_orderkey", "l_partkey", "l_extendedprice", "l_tax"}
    assert read.get("documents", set()) <= {"doc_id"}
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in plan


def test_top_values_are_cut_before_the_shuffle(spark):
    plan = plan_of(profiling.top_values(Inputs(spark, SAMPLE).table("lineitem"), ["l_tax"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_order_with_a_third_of_all_lines_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 60000
        key = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
        items = spark.range(0, n, 1, 16).select(
            key.alias("order_id"),
            F.col("id").alias("order_item_id"),
            F.md5(F.col("id").cast("string")).alias("product_id"),
            (F.col("id") % 5).alias("seller_id"),
            F.lit(None).cast("timestamp_ntz").alias("shipping_limit_datetime"),
            F.lit(1).alias("item_price"),
            F.lit(1).alias("item_freight_value"),
        )
        orders = spark.range(n).select(
            F.col("id").alias("order_id"),
            F.col("id").alias("order_customer_id"),
            F.lit("Delivered").alias("order_status"),
        )
        reviews = spark.range(n).where("id % 2 = 1").select(
            F.col("id").alias("order_id"), F.lit(4).alias("review_score")
        )
        lines = core.fact_order_lines(items, orders, reviews)
        collected = lines.agg(F.count("*"), F.sum("review_score"), F.max("product_id"))
        got = tuple(collected.collect()[0])
        plan = collected._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    hot = n // 3
    other = sum(1 for i in range(n) if i % 3 and i % 2)
    assert got[:2] == (n, 4 * (hot + other))
    print("skewed joins", plan.split("Initial Plan")[0].count("skew=true"))
    assert plan.count("skew=true") >= 1, plan


def test_vector_search_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARED_BYTES", 0)
    vecs = Inputs(spark, SAMPLE).table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    plan = plan_of(vectors.vector_topk(vecs, vecs))
    # The one join is that of query blocks with the stored blocks of a place.
    assert plan.count("Join") == 1 and "CartesianProduct" not in plan


def test_no_quantile_gathers_a_column_in_one_task(spark):
    assert "percentile(" not in plan_of(all_queries()["profile_sketches"](spark, SAMPLE))


def test_texts_of_a_task_are_not_held_at_once(spark):
    hits = spark.createDataFrame([], "query_id long, rank int, doc_id long")
    docs = spark.createDataFrame([], "doc_id long, model_name string, text string")
    assert "ObjectHashAggregate" not in plan_of(vectors.context_assemble(hits, docs))


def test_a_task_is_given_little_shuffled_data(spark):
    before = spark.conf.get(session.TASK_INPUT)
    try:
        for given, wanted in (("64MB", 16 << 20), ("1g", 16 << 20), ("67108864b", 16 << 20), ("8m", 8 << 20)):
            spark.conf.set(session.TASK_INPUT, given)
            session.configure(spark)
            assert session._bytes(spark.conf.get(session.TASK_INPUT)) == wanted
    finally:
        spark.conf.set(session.TASK_INPUT, before)


def test_daily_metrics_write_no_row_three_times(spark):
    plan = plan_of(all_queries()["fact_product_daily_metrics"](spark, SAMPLE))
    assert "Expand" not in plan


def test_zips_are_distinct_before_they_meet_customers(spark):
    zips = spark.createDataFrame([(1, "a", "x")] * 500, "zip_code int, city string, state string")
    people = spark.range(100).selectExpr(
        "id as customer_id", "1 as customer_zip_code", "'c' as customer_city", "'s' as customer_state"
    )
    found = core.dim_customers(people, zips)
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_load_time_has_one_type(spark):
    zips = spark.createDataFrame([(1, "a", "x")], "zip_code int, city string, state string")
    types = {core.dim_location(zips, at).schema["created_at"].dataType for at in (None, "2018-01-01")}
    assert len(types) == 1


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver started elsewhere, whose workers cannot import the package."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("vector_topk", "correlation_matrix", "src_doc_catalog"):
    assert queries()[name](spark, {SAMPLE!r}).count() > 0
print("all ran")
"""
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_stored_facts_are_joined_where_they_lie(spark):
    house = Inputs(spark, SAMPLE).with_stored("fact_orders", "fact_order_lines")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(house.get("agg_product_quality_metrics"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The one shuffle is that of the reduced rows to their products.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2


def test_changes_are_found_by_whole_numbers(spark):
    old = spark.createDataFrame([(1, "2018-01-01"), (2, "2018-01-02")], "order_id long, day string")
    new = spark.createDataFrame([(2, "2018-01-02"), (2, "2018-01-02"), (3, None)], old.schema)
    found = maintain.changed_keys(old, new, "order_id")
    assert sorted(r.order_id for r in found.collect()) == [1, 2, 3]
    assert "decimal" not in plan_of(found)


def test_states_bucketed_on_the_key_are_compared_where_they_lie(spark):
    old, new = (Inputs(spark, SAMPLE).with_stored("fact_order_lines") for _ in range(2))
    lines = [house.get("fact_order_lines") for house in (old, new)]
    plan = plan_of(maintain.changed_keys(*lines, "order_id"))
    below = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2


def test_shuffles_of_a_stored_model_are_removed(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(key), tracker.shuffleStatuses().size()
    house = Inputs(spark, SAMPLE).with_stored("fact_orders")
    assert house.get("fact_orders").count() > 0
    # The count is one of ours; the write made many.
    assert tracker.shuffleStatuses().size() <= before + 1
    assert spark.conf.get(key) == set_before
