"""The registered queries: every operator applied to whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import (
    clean_datetime_string,
    lead_channel,
    lead_tier,
    standardize_to_datetime,
)
from martwright.operators import (
    charts,
    documents,
    ordering,
    profiling,
    quality,
    questions,
    sketches,
    vectors,
)
from martwright.operators.durable import scratch_path
from martwright.plans import checks, maintain
from martwright.plans.catalog import MODELS, Warehouse
from martwright.schemas import RAW_SCHEMAS
from martwright.session import configure, setting, shuffles_removed
from martwright.sources import docs, files, tables
from martwright.sources.naming import schema_name_column
from martwright.sources.sample import SampleTables

AS_OF = "2018-12-31 00:00:00"
# Lines of one bucket of the stored facts, which is joined and reduced in one task.
BUCKET_LINES = 1 << 18
LEAST_BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals and floats as double, integers as bigint: one type per kind of value."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns of floating sums, cut to the digits that do not depend on the order of adding."""
    return df.withColumns(
        {c: F.round(F.col(c).cast("decimal(38,10)"), digits) for c in columns}
    )


class Inputs:
    """What a query reads: sample tables, canonical raw tables and models."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.sample = SampleTables(spark, folder)
        self.warehouse = Warehouse(self.sample.raw, as_of=AS_OF)

    def table(self, name: str) -> DataFrame:
        return self.sample.read(name)

    def model(self, name: str) -> DataFrame:
        return self.warehouse.get(name)

    def with_stored(self, *names: str) -> Warehouse:
        """The warehouse with some models written once, for queries over many models."""
        for name in names:
            self.store(self.warehouse, name)
        return self.warehouse

    def store(self, house: Warehouse, name: str) -> DataFrame:
        """Write a model and use the copy for everything built on it.

        It is bucketed on the key it is joined on, so the models built on it join and reduce it where it
        lies. The last shuffle before it is written has the same number of parts.
        """
        buckets = max(LEAST_BUCKETS, -(-self.table("lineitem").count() // BUCKET_LINES))
        key, table = MODELS[name].bucket_by, f"{name}_{uuid.uuid4().hex}"
        parts = setting(self.spark, "spark.sql.shuffle.partitions", str(buckets))
        with parts, shuffles_removed(self.spark):
            writer = house.get(name).write.format("parquet").bucketBy(buckets, key).sortBy(key)
            writer.option("path", scratch_path(self.spark, name)).saveAsTable(table)
        house.put(name, self.spark.table(table))
        return house.get(name)


def query(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register under the function's name; a trailing underscore avoids a name already taken."""

    def call(spark: SparkSession, folder: str) -> DataFrame:
        return plain_types(run(Inputs(spark, folder)))

    _QUERIES[run.__name__.rstrip("_")] = call
    return run


def _model(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return plain_types(Inputs(spark, folder).model(name))


def all_queries() -> dict[str, Query]:
    return {**{name: partial(_model, name) for name in MODELS}, **_QUERIES}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Sources and sinks


@query
def src_raw_tables(inputs: Inputs) -> DataFrame:
    """Rows, distinct keys and key range of each raw table, written as CSV and loaded by name."""
    parts = []
    folder = scratch_path(inputs.spark, "raw")
    loaded = tables.RawTables(inputs.spark, folder, "csv")
    for name, schema in RAW_SCHEMAS.items():
        table = inputs.sample.raw(name)
        # The order of the columns in a file does not matter.
        files.sink_csv(table.select(*reversed(table.columns)), f"{folder}/{name}.csv")
        key = F.col(schema[0].name).cast("string")
        parts.append(
            loaded.get(name).agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("row_count"),
                F.count_distinct(key).alias("distinct_keys"),
                F.min(key).alias("first_key"),
                F.max(key).alias("last_key"),
            )
        )
    return _union(parts)


def _csv_texts(inputs: Inputs) -> DataFrame:
    return inputs.table("documents").select("doc_id", "lang", "source", "text")


@query
def src_csv_encoded(inputs: Inputs) -> DataFrame:
    """Documents written as Latin-1 CSV in one folder and read back without being told."""
    path = scratch_path(inputs.spark, "latin")
    files.sink_csv(_csv_texts(inputs), path, encoding="ISO-8859-1")
    return files.read_csv_encoded(
        inputs.spark, path, "doc_id bigint, lang string, source string, text string"
    )


@query
def sink_csv(inputs: Inputs) -> DataFrame:
    """Daily sales written as CSV and read back."""
    sales = inputs.model("agg_daily_sales")
    path = files.sink_csv(sales, scratch_path(inputs.spark, "csv"))
    return inputs.spark.read.schema(sales.schema).option("header", True).csv(path)


@query
def sink_table(inputs: Inputs) -> DataFrame:
    """The customer performance mart built on stored, bucketed order facts."""
    spark = inputs.spark
    path = scratch_path(spark, "warehouse")
    # A name of its own for each run: nothing that exists is touched.
    database = f"martwright_{uuid.uuid4().hex}"
    spark.sql(f"create database {database} location '{path}'")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = tables.sink_table(
        inputs.model("fact_orders"), "fact_orders", database, "table", "order_id", buckets
    )
    inputs.warehouse.put("fact_orders", stored)
    return tables.sink_table(
        inputs.model("agg_customer_performance"), "customers", database, "view"
    )


@query
def sink_table_incremental(inputs: Inputs) -> DataFrame:
    """The order fact stored by month, then stored again with one order changed.

    ``rewritten`` tells which months the second run wrote; the others still lie where the first
    run put them.
    """
    path = scratch_path(inputs.spark, "orders-by-month")
    orders = inputs.with_stored("fact_orders").get("fact_orders")
    tables.sink_months(orders, path, "order_purchase_datetime")
    last = orders.agg(F.max("order_id")).first()[0]
    total = F.when(F.col("order_id") == last, F.col("order_total") + 1).otherwise(F.col("order_total"))
    changed = orders.withColumn("order_total", total.cast(orders.schema["order_total"].dataType))
    tables.sink_months(changed, path, "order_purchase_datetime")
    months = F.date_format("order_purchase_datetime", "yyyy-MM").alias("month")
    by_month = tables.read_months(inputs.spark, path, with_folder=True).groupBy(months).agg(
        F.count("*").alias("row_count"),
        F.sum("order_total").alias("order_total"),
        F.first("_folder").alias("_folder"),
        F.count_distinct("_folder").alias("folders"),
    )
    first = tables.read_months(inputs.spark, path, 1, with_folder=True).select("_folder").distinct()
    known = first.withColumnRenamed("_folder", "_first")
    return by_month.join(known, F.col("_folder") == F.col("_first"), "left").select(
        "month", "row_count", "order_total", "folders", F.col("_first").isNull().alias("rewritten")
    )


def _earlier(inputs: Inputs) -> Warehouse:
    """A past state of the warehouse: some orders were not there, some are gone since, and some had
    other prices or dates."""

    def raw(name: str) -> DataFrame:
        table = inputs.sample.raw(name)
        if name not in ("raw_orders", "raw_order_items"):
            return table
        key = F.col("order_id")
        gone = table.where(key % 29 == 0).withColumn("order_id", -key - 1)
        was = table.where(key % 31 != 0)
        if name == "raw_orders":
            moved = F.when(key % 37 == 0, "2017-02-03 04:05:06").otherwise(
                F.col("order_purchase_timestamp")
            )
            was = was.withColumn("order_purchase_timestamp", moved)
        else:
            was = was.withColumn("price", F.when(key % 41 == 0, F.col("price") + 1).otherwise(F.col("price")))
        return was.unionByName(gone).to(table.schema)

    return Warehouse(raw, as_of=AS_OF)


def _both_states(inputs: Inputs, *names: str) -> tuple[dict, dict]:
    """Stored models of the past and the present state."""
    out = []
    for house in (_earlier(inputs), inputs.warehouse):
        out.append({**{name: inputs.store(house, name) for name in names}, "house": house})
    return tuple(out)


@query
def maintain_product_daily(inputs: Inputs) -> DataFrame:
    """Product metrics of a past state, brought to the present by the keys that changed."""
    old, new = _both_states(inputs, "fact_orders", "fact_order_lines")
    path = scratch_path(inputs.spark, "old-product-daily")
    with shuffles_removed(inputs.spark):
        old["house"].get("fact_product_daily_metrics").write.parquet(path)
    return maintain.product_daily_metrics(
        inputs.spark.read.parquet(path),
        old["fact_order_lines"],
        old["fact_orders"],
        new["fact_order_lines"],
        new["fact_orders"],
        as_of=AS_OF,
    )


@query
def maintain_daily_sales(inputs: Inputs) -> DataFrame:
    """Daily sales of a past state, brought to the present by the days that changed."""
    old, new = _both_states(inputs, "fact_orders")
    path = scratch_path(inputs.spark, "old-daily-sales")
    with shuffles_removed(inputs.spark):
        old["house"].get("agg_daily_sales").write.parquet(path)
    return maintain.daily_sales(
        inputs.spark.read.parquet(path), old["fact_orders"], new["fact_orders"]
    )


@query
def src_sql_adhoc(inputs: Inputs) -> DataFrame:
    """A SELECT without a limit on a registered mart: the first twenty rows."""
    inputs.model("agg_daily_sales").createOrReplaceTempView("agg_daily_sales")
    text = """
      select order_date, total_order_count, total_order_value from agg_daily_sales
      order by total_order_value desc, order_date ;
    """
    return tables.run_sql(inputs.spark, text)


def _doc_rows(inputs: Inputs) -> DataFrame:
    """Conversations as documentation: one model per conversation, one column per turn."""
    turns = inputs.table("conversations")
    return turns.select(
        F.lit("conversations").alias("file_path"),
        F.col("conv_id").cast("string").alias("model_name"),
        F.lit("conversation").alias("description"),
        F.col("turn").cast("int").alias("column_pos"),
        F.col("role").alias("column_name"),
        F.col("text").alias("column_description"),
    )


def _write_descriptions(described_rows: DataFrame, path: str) -> None:
    """Description files of some hundred models each."""
    models = described_rows.agg(F.count_distinct("model_name")).first()[0]
    part = F.pmod(F.xxhash64("model_name"), F.lit(max(1, -(-models // 200)))).alias("part")
    column = F.struct(
        F.col("column_pos"),
        F.struct(
            F.col("column_name").alias("name"), F.col("column_description").alias("description")
        ).alias("c"),
    )
    model = F.struct(
        F.col("model_name").alias("name"), "description", F.col("columns.c").alias("columns")
    )
    described = (
        described_rows.groupBy("model_name", "description")
        .agg(F.sort_array(F.collect_list(column)).alias("columns"))
        .groupBy(part)
        .agg(F.collect_list(model).alias("models"))
        .select("part", F.to_json(F.struct("models")).alias("value"))
    )
    described.write.partitionBy("part").text(path)


@query
def src_doc_catalog(inputs: Inputs) -> DataFrame:
    """Conversations written as description files, one model each, then read back as column rows."""
    path = scratch_path(inputs.spark, "docs")
    _write_descriptions(_doc_rows(inputs), path)
    return docs.read_doc_catalog(inputs.spark, path, "*.txt").drop("file_path")


def _vectors(inputs: Inputs) -> DataFrame:
    return inputs.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query
def sink_vector_upsert(inputs: Inputs) -> DataFrame:
    """Vectors of the even labels stored first, then all: the second run adds the others only."""
    path = scratch_path(inputs.spark, "vectors")
    rows = _vectors(inputs).withColumnRenamed("id", "doc_id")
    docs.vector_upsert(rows.where(F.col("label") % 2 == 0).withColumn("run", F.lit(1)), path)
    stored = docs.vector_upsert(rows.withColumn("run", F.lit(2)), path)
    return stored.select("doc_id", "label", "run", F.size("embedding").alias("dimensions"))


# Macros


def _date_texts(inputs: Inputs) -> DataFrame:
    """Every event time written in one of ten styles."""
    styles: list[Column] = [
        F.date_format("ts", pattern)
        for pattern in (
            "yyyy-MM-dd HH:mm:ss",
            "M/d/yyyy H:mm",
            "yyyy-MM-dd",
            "MM-dd-yyyy HH:mm:ss",
            "yyyy/MM/dd H:",
            "M/d/yyyy",
            "yyyy-MM-dd'T'HH:mm:ss",
            "yyyy-M-d H:m:s",
        )
    ] + [F.lit("  "), F.lit(None).cast("string")]
    style = (F.col("event_id") % len(styles)).cast("int")
    return inputs.table("events").select("event_id", F.get(F.array(*styles), style).alias("date_text"))


@query
def clean_datetime_string_(inputs: Inputs) -> DataFrame:
    return _date_texts(inputs).select(
        "event_id", clean_datetime_string("date_text").alias("clean_text")
    )


@query
def standardize_to_datetime_(inputs: Inputs) -> DataFrame:
    return _date_texts(inputs).select(
        "event_id", standardize_to_datetime("date_text").alias("standard_datetime")
    )


@query
def classify_lead_type(inputs: Inputs) -> DataFrame:
    kind = F.col("lead_type")
    return inputs.sample.raw("raw_closed_deals").select(
        "mql_id", kind, lead_channel(kind).alias("channel"), lead_tier(kind).alias("tier")
    )


@query
def schema_name_for_env(inputs: Inputs) -> DataFrame:
    """Documents filed under a schema per source, with the language standing for the environment."""
    env = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "uat").otherwise("prod")
    return inputs.table("documents").select("doc_id", schema_name_column(F.col("source"), env).alias("schema_name"))


# Data quality


# What many other models are built on.
STORED = ("fact_orders", "fact_order_lines")


def _checked(df: DataFrame, model: str) -> DataFrame:
    return df.select(F.lit(model).alias("model"), "column_name", "value", "failures")


@query
def dq_not_null(inputs: Inputs) -> DataFrame:
    """All declared not-null checks, with the number of failing rows."""
    return checks.check_not_null(inputs.with_stored(*STORED))


@query
def dq_suite(inputs: Inputs) -> DataFrame:
    """All declared checks that counting decides, one aggregation for each model."""
    return checks.check_counts(inputs.with_stored(*STORED))


@query
def dq_unique(inputs: Inputs) -> DataFrame:
    """All declared uniqueness checks, and the line key that is known to repeat."""
    line = inputs.model("stg_order_items").select(
        F.concat_ws("-", "order_id", "order_item_id").alias("line_key")
    )
    return checks.check_unique(inputs.with_stored(*STORED)).unionByName(
        _checked(quality.unique(line, ["line_key"]), "stg_order_items")
    )


@query
def dq_relationships(inputs: Inputs) -> DataFrame:
    """All declared relations, and documents checked against their labels."""
    unlabelled = quality.relationships(
        inputs.table("documents"), "doc_id", inputs.table("labels"), "doc_id"
    )
    return checks.check_relationships(inputs.with_stored(*STORED)).unionByName(
        _checked(unlabelled, "documents")
    )


@query
def dq_accepted_values(inputs: Inputs) -> DataFrame:
    """The declared check, and order states other than open or finished."""
    open_or_done = quality.accepted_values(inputs.table("orders"), "o_orderstatus", ["O", "F"])
    return checks.check_accepted_values(inputs.warehouse).unionByName(
        _checked(open_or_done, "orders")
    )


@query
def dq_in_set(inputs: Inputs) -> DataFrame:
    """The declared check, and the deals without a lead."""
    linked = quality.in_set(inputs.model("fact_closed_deals"), "mql_link_status", ["linked"])
    return checks.check_in_set(inputs.warehouse).unionByName(_checked(linked, "linked_deals"))


@query
def dq_between(inputs: Inputs) -> DataFrame:
    """All declared ranges, and lines outside narrower ones."""
    narrow = {"l_linenumber": (2, 6), "l_partkey": (10, None)}
    return checks.check_between(inputs.with_stored(*STORED)).unionByName(
        _checked(quality.between(inputs.table("lineitem"), narrow), "lineitem")
    )


@query
def dq_schema_contract(inputs: Inputs) -> DataFrame:
    """Columns documented in description files against the columns that tables have.

    Every conversation stands for a table, with a column for each turn. The files, written by
    Spark and read back as a catalogue, lack the turns numbered 3 and still hold a dropped column for
    conversations that have a turn 2.
    """
    turns = _doc_rows(inputs).withColumn(
        "column_name", F.concat(F.initcap("column_name"), F.lit("_"), F.col("column_pos"))
    )
    dropped = turns.where("column_pos = 2").withColumn("column_name", F.lit("Dropped_Column"))
    documented = turns.where("column_pos <> 3").unionByName(dropped.withColumn("column_pos", F.lit(99)))
    path = scratch_path(inputs.spark, "contract")
    _write_descriptions(documented, path)
    catalog = docs.read_doc_catalog(inputs.spark, path, "*.txt")
    known = catalog.where("column_name is not null").select(
        F.col("model_name").alias("model"), "column_name"
    )
    actual = turns.select(F.col("model_name").alias("model"), F.lower("column_name").alias("column_name"))
    return quality.schema_contract(known, actual)


@query
def dq_csv_shape(inputs: Inputs) -> DataFrame:
    """The first records of CSV files of documents that break the shape of their header.

    Every file has a header and a 64th of the documents, each with its whole text quoted;
    documents of some sources have a field too many or too few.
    """
    path = scratch_path(inputs.spark, "shape")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    source, part = F.col("source"), F.pmod("doc_id", F.lit(64)).alias("part")
    line = (
        F.when(source == "src7", F.concat_ws(",", "doc_id", quoted))
        .when(source == "src11", F.concat_ws(",", "doc_id", "lang", quoted, F.lit("extra")))
        .otherwise(F.concat_ws(",", "doc_id", "lang", quoted))
    )
    rows = inputs.table("documents")
    lines = rows.select(part, "doc_id", line.alias("value"))
    headers = rows.select(part).distinct().select(
        "part", F.lit(-1).cast("long").alias("doc_id"), F.lit("doc_id,lang,text").alias("value")
    )
    (
        headers.unionByName(lines)
        .repartition("part")
        .sortWithinPartitions("part", "doc_id")
        .select("part", "value")
        .write.partitionBy("part")
        .text(path)
    )
    found = files.csv_shape(inputs.spark, path)
    return found.withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1)).drop("file")


# Profiling


def _joined_names(df: DataFrame) -> DataFrame:
    """Name lists as text, for comparison."""
    return df.select(
        *[
            F.array_join(f.name, ",").alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


@query
def profile_columns(inputs: Inputs) -> DataFrame:
    return _joined_names(profiling.profile_columns(inputs.table("orders"))).withColumn(
        "null_percentage", F.round("null_percentage", 4)
    )


@query
def profile_numeric(inputs: Inputs) -> DataFrame:
    profile = profiling.profile_numeric(inputs.table("lineitem"))
    return _rounded(profile, 4, "mean", "median", "std")


@query
def profile_top_values(inputs: Inputs) -> DataFrame:
    return profiling.profile_top_values(inputs.table("lineitem"))


@query
def profile_sketches(inputs: Inputs) -> DataFrame:
    """Lines profiled from the sketches of four parts, added in two runs, against the exact profile.

    ``new_parts`` are those the second run read; the ``_ok`` columns say whether the estimates
    lie within the errors that the sketches promise.
    """
    lines = inputs.table("lineitem")
    store = sketches.SketchStore(inputs.spark, scratch_path(inputs.spark, "sketches"))
    parts = {f"part-{i}": lines.where(F.pmod("l_orderkey", F.lit(4)) == i) for i in range(4)}
    store.update({p: parts[p] for p in ("part-0", "part-1", "part-2")})
    new = store.update(parts)
    estimated = store.profile()
    exact = profiling.profile_columns(lines, samples=0).select("column_name", "unique_count")
    numbers = profiling.numeric_columns(lines)
    # F.percentile would gather all values of a column in one task.
    halves = ordering.exact_quantiles(lines, numbers, [0.47, 0.53]).select(
        "column_name",
        F.get("quantiles", F.lit(0)).alias("below"),
        F.get("quantiles", F.lit(1)).alias("above"),
    )
    distinct_gap = F.abs(F.col("unique_estimate") - F.col("unique_count")) / F.col("unique_count")
    median = F.col("median_estimate").between(F.col("below"), F.col("above"))
    found = estimated.join(exact, "column_name").join(halves, "column_name", "left")
    return _rounded(
        found.select(
            "column_name",
            "row_count",
            "null_count",
            "mean",
            "std",
            "min_val",
            "max_val",
            (distinct_gap < 0.08).alias("distinct_ok"),
            F.coalesce(median, F.lit(True)).alias("median_ok"),
            F.lit(len(new)).alias("new_parts"),
        ),
        4,
        "mean",
        "std",
    )


def _roles(df: DataFrame) -> DataFrame:
    return profiling.profile_roles(profiling.profile_columns(df, samples=0))


@query
def profile_roles(inputs: Inputs) -> DataFrame:
    return _roles(inputs.table("events"))


def _dataset(df: DataFrame) -> DataFrame:
    return profiling.profile_dataset(_roles(df))


@query
def profile_dataset(inputs: Inputs) -> DataFrame:
    return _joined_names(_dataset(inputs.table("events")))


@query
def insight_summary(inputs: Inputs) -> DataFrame:
    events = inputs.table("events")
    return profiling.insight_summary(
        _dataset(events), profiling.profile_numeric(events), intent="trend"
    )


# Chart data


@query
def chart_recommend(inputs: Inputs) -> DataFrame:
    return charts.recommend(_dataset(inputs.table("orders")))


@query
def chart_fallback(inputs: Inputs) -> DataFrame:
    return charts.fallback(_dataset(inputs.table("events")))


@query
def chart_top10(inputs: Inputs) -> DataFrame:
    return charts.top_n(inputs.model("fact_order_lines"), "product_id", "item_price")


@query
def chart_group_agg(inputs: Inputs) -> DataFrame:
    """A summed, an averaged and a counted metric over the same two keys."""
    orders = inputs.model("fact_orders")
    keys = ["order_status", "review_count"]
    summed = charts.group_agg(orders, keys, "order_total").withColumnRenamed("order_total", "y")
    averaged = charts.group_agg(orders, keys, "order_item_count").withColumnRenamed(
        "order_item_count", "y"
    )
    counted = charts.group_agg(orders, keys, "review_count").withColumnRenamed("count", "y")
    parts = {"sum": summed, "mean": averaged, "count": counted}
    return _union(
        [
            df.select(
                F.lit(kind).alias("rule"),
                *keys,
                F.round(F.col("y").cast("decimal(38,10)"), 4).alias("y"),
            )
            for kind, df in parts.items()
        ]
    )


@query
def chart_pie_top8(inputs: Inputs) -> DataFrame:
    lines = inputs.model("fact_order_lines")
    return charts.pie_top(lines, "seller_id", "item_price")


@query
def chart_time_series(inputs: Inputs) -> DataFrame:
    return charts.time_series(inputs.table("events"), "ts", "event_id")


@query
def chart_time_series_bounded(inputs: Inputs) -> DataFrame:
    return charts.downsampled_series(inputs.table("events"), "ts", "value", "event_id", width=200)


@query
def trend_pct_change(inputs: Inputs) -> DataFrame:
    trend = charts.trend_pct_change(inputs.table("events"), "ts", "value", "event_id")
    return _rounded(trend, 4, "pct_change")


@query
def chart_histogram(inputs: Inputs) -> DataFrame:
    bars = charts.histogram(inputs.table("lineitem"), "l_quantity")
    return _rounded(bars, 4, "bin_start", "bin_end", "mean")


@query
def chart_box(inputs: Inputs) -> DataFrame:
    boxes = charts.box_summary(
        inputs.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    )
    return _rounded(boxes, 4, *boxes.columns[1:])


@query
def correlation_matrix(inputs: Inputs) -> DataFrame:
    lines = inputs.table("lineitem")
    matrix = charts.correlation_matrix(lines, profiling.numeric_columns(lines))
    return _rounded(matrix, 6, "correlation")


@query
def chart_scatter(inputs: Inputs) -> DataFrame:
    return charts.scatter(
        inputs.table("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"
    )


@query
def chart_scatter_sample(inputs: Inputs) -> DataFrame:
    """A hundred lines for each return flag, picked by the hash of the line's key."""
    return charts.sampled_scatter(
        inputs.table("lineitem"),
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        n=100,
    )


# Texts and vectors


@query
def doc_build(inputs: Inputs) -> DataFrame:
    return documents.doc_build(_doc_rows(inputs)).select("model_name", "text")


@query
def doc_truncate(inputs: Inputs) -> DataFrame:
    return inputs.table("documents").select(
        "doc_id", documents.doc_truncate(F.col("text")).alias("text")
    )


@query
def doc_id_md5(inputs: Inputs) -> DataFrame:
    return inputs.table("documents").select(
        "doc_id", documents.doc_id_md5(F.col("source"), F.col("doc_id").cast("string")).alias("uid")
    )


@query
def doc_incremental_dedupe(inputs: Inputs) -> DataFrame:
    """Documents not labelled yet, counted as new."""
    incoming = inputs.table("documents").select("doc_id", "source", "n_chars")
    return documents.incremental_dedupe(incoming, inputs.table("labels").select("doc_id"))


@query
def embed_stats(inputs: Inputs) -> DataFrame:
    """Documents by fate: labelled ones are stored already, empty vectors are errors."""
    found = inputs.table("documents").join(inputs.table("labels"), "doc_id", "left")
    status = (
        F.when(F.col("quality").isNull(), "embedded")
        .when(F.col("toxic") == 1, "error")
        .otherwise("skipped")
    )
    return documents.embed_stats(found.select(F.col("source").alias("file_path"), status.alias("status")))


@query
def vector_topk(inputs: Inputs) -> DataFrame:
    """Every vector asked against all vectors."""
    vecs = _vectors(inputs)
    return vectors.vector_topk(vecs, vecs, k=3)


@query
def vector_topk_indexed(inputs: Inputs) -> DataFrame:
    """The same search in a stored index, to which the vectors of odd ids were added later."""
    vecs = _vectors(inputs).select("id", "embedding")
    path = scratch_path(inputs.spark, "vector-index")
    vectors.VectorIndex.build(vecs.where("id % 2 = 0"), path).add(vecs.where("id % 2 <> 0"))
    return vectors.VectorIndex.open(inputs.spark, path).search(vecs, k=3)


@query
def context_assemble(inputs: Inputs) -> DataFrame:
    """The documents with the ids of the nearest vectors, whole, put together per query."""
    vecs = _vectors(inputs)
    texts = inputs.table("documents").select(
        "doc_id", F.col("source").alias("model_name"), "text"
    )
    return vectors.context_assemble(vectors.vector_topk(vecs, vecs, k=3), texts)


@query
def classify_sql_request(inputs: Inputs) -> DataFrame:
    return inputs.table("conversations").select(
        "conv_id", "turn", questions.classify_sql_request(F.col("text")).alias("is_sql_request")
    )


@query
def classify_intents(inputs: Inputs) -> DataFrame:
    intents = questions.classify_intents(F.col("text"))
    return inputs.table("conversations").select(
        "conv_id",
        "turn",
        F.array_join(intents, ",").alias("intents"),
        questions.primary_intent(intents).alias("primary_intent"),
    )


@query
def extract_fenced_sql(inputs: Inputs) -> DataFrame:
    """Answers with their last line fenced for user turns, plain otherwise."""
    fenced = F.concat(F.lit("Answer:\n```sql\n"), "text", F.lit("\n```\nend"))
    answer = F.when(F.col("role") == "user", fenced).otherwise(F.concat(F.lit(" \n"), "text", F.lit(" ")))
    return inputs.table("conversations").select(
        "conv_id", "turn", questions.extract_fenced_sql(answer).alias("sql_text")
    )


@query
def text_ascii_clean(inputs: Inputs) -> DataFrame:
    """The CSV cleaning job: Latin-1 files found and read, all text columns cleaned, UTF-8 out.

    A line of typographic signs is put before each text.
    """
    spark = inputs.spark
    latin = "".join(chr(code) for code in (*range(0xA0, 0xAD), *range(0xAE, 0x100)))
    rows = inputs.table("documents").select(
        "doc_id", "lang", F.concat(F.lit("é "), "source").alias("source"),
        F.concat(F.lit(latin + " "), "text").alias("text"),
    )
    source = files.sink_csv(rows, scratch_path(spark, "latin"), encoding="ISO-8859-1")
    target = scratch_path(spark, "cleaned")
    files.clean_csv(spark, source, target, rows.schema)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(target)
