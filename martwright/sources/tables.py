"""Raw tables in, models out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.plans.catalog import MODELS, Warehouse
from martwright.schemas import RAW_SCHEMAS
from martwright.sources.commits import CommitLog
from martwright.sources.naming import schema_name_for_env


# Tables with free text, whose records may run over several lines; the files of all other tables
# are read in splits.
MULTI_LINE = {"raw_order_reviews"}
_CORRUPT = "_corrupt_record"
_MONTH = "_month"


class RawTables:
    """The canonical raw tables of a folder, read on demand with their fixed schema.

    ``fmt`` is ``csv`` (one file or folder ``<name>.csv`` per table, with a header) or
    ``parquet``. Columns are taken by name, in any order, and others are ignored; a missing one is
    an error. A CSV record that does not fit its header or a type is an error too, unless
    ``set_aside`` is given: then it is left out here and listed by :meth:`bad_records`.
    """

    def __init__(
        self, spark: SparkSession, folder: str, fmt: str = "csv", set_aside: bool = False
    ):
        self.spark, self.folder, self.fmt, self.set_aside = spark, folder, fmt, set_aside

    def get(self, name: str) -> DataFrame:
        if self.fmt != "csv":
            reader = self.spark.read.schema(RAW_SCHEMAS[name])
            return reader.format(self.fmt).load(f"{self.folder}/{name}.{self.fmt}")
        texts, problem = self._records(name)
        if self.set_aside:
            texts, guard = texts.where(problem.isNull()), F.lit(True)
        else:
            complaint = F.concat(F.lit(f"{name}: "), problem)
            # The check hangs on every column, so no selection of columns can drop it.
            guard = problem.isNull() | F.raise_error(complaint).cast("boolean")
        return texts.select(
            *[
                F.when(guard, F.col(f.name).try_cast(f.dataType)).alias(f.name)
                for f in RAW_SCHEMAS[name]
            ]
        )

    def bad_records(self, name: str) -> DataFrame:
        """``problem`` and the texts of the records that do not fit."""
        texts, problem = self._records(name)
        return texts.withColumn("problem", problem).where("problem is not null").drop(_CORRUPT)

    def _records(self, name: str) -> tuple[DataFrame, Column]:
        """All records as text, by the header's names, and what is wrong with one (or NULL)."""
        path = f"{self.folder}/{name}.csv"
        reader = (
            self.spark.read.option("header", True)
            .option("escape", '"')
            .option("multiLine", name in MULTI_LINE)
        )
        header = reader.csv(path).columns
        missing = [f.name for f in RAW_SCHEMAS[name] if f.name not in header]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        schema = ", ".join(f"`{c}` string" for c in (*header, _CORRUPT))
        texts = (
            reader.schema(schema)
            .option("enforceSchema", False)
            .option("columnPruning", False)
            .option("columnNameOfCorruptRecord", _CORRUPT)
            .csv(path)
        )
        problem = F.when(F.col(_CORRUPT).isNotNull(), "fields do not match the header")
        for f in RAW_SCHEMAS[name]:
            value = F.col(f.name)
            problem = problem.when(
                value.isNotNull() & value.try_cast(f.dataType).isNull(),
                F.concat(F.lit(f"{f.name} is not {f.dataType.simpleString()}: "), value),
            )
        return texts, problem


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column descriptions, which Spark stores with the table."""
    return df.select(
        *[
            F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c)
            for c in df.columns
        ]
    )


def sink_table(
    df: DataFrame,
    name: str,
    database: str,
    stored: str = "table",
    bucket_by: str | None = None,
    buckets: int | None = None,
    comments: dict[str, str] | None = None,
    month_of: str | None = None,
) -> DataFrame:
    """Persist a model as a table, or register it as a view, and return it as stored.

    Tables joined on one key are bucketed and sorted on it, so that later joins and
    per-key aggregations need no shuffle; ``buckets`` must then be given, as it follows from the
    size of the data: a bucket is sorted in one task. Tables with ``month_of`` (a date or time
    column) are partitioned by its month instead, kept as ``<column>_month``, so that a date filter
    reads the months it needs. Views live in the session.
    """
    spark = df.sparkSession
    df = with_comments(df, comments or {})
    if stored == "view":
        view = f"{database}_{name}"
        df.createOrReplaceTempView(view)
        return spark.table(view)
    if bucket_by and month_of:
        raise ValueError("a table is either bucketed or partitioned by month")
    spark.sql(f"create database if not exists `{database}`")
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        if not buckets:
            raise ValueError("a bucketed table needs its number of buckets")
        # Rows are brought to their bucket first: one file per bucket, not one per task.
        writer = (
            df.repartition(buckets, bucket_by)
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, bucket_by)
            .sortBy(bucket_by)
        )
    elif month_of:
        month = f"{month_of}_month"
        dated = df.withColumn(month, F.date_format(month_of, "yyyy-MM"))
        # Rebalanced by month: few files in each, and a large month is split.
        writer = (
            dated.hint("rebalance", month).write.mode("overwrite").format("parquet").partitionBy(month)
        )
    writer.saveAsTable(f"`{database}`.`{name}`")
    return spark.table(f"`{database}`.`{name}`")


def _month(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))


def month_fingerprints(df: DataFrame, month_of: str) -> DataFrame:
    """``month``, ``rows`` and ``digest`` of each month, whatever the order of the rows.

    The digest is the sum of 64-bit hashes of whole rows, so only sums are shuffled. Rows without
    a time have the month ``none``.
    """
    values = [
        F.to_json(F.col(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema
    ]
    return df.groupBy(_month(month_of).alias("month")).agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*values).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def sink_months(df: DataFrame, path: str, month_of: str) -> DataFrame:
    """Materialize ``df`` by month of a time column; months that did not change are not rewritten.

    The log beside the data keeps rows, digest and folder of each month. Months whose fingerprint
    differs from the stored one are written, those that are gone are left out, and one commit makes
    all of it visible: a reader never sees some months new and others old. A change of the columns
    rewrites all months. Returned is the table as committed, see :func:`read_months`.

    A month is a few bytes of the log; a table of a hundred years has 1,200.
    """
    spark = df.sparkSession
    shape = df.schema.json()
    found = {r["month"]: [r["rows"], r["digest"]] for r in month_fingerprints(df, month_of).collect()}

    def write(state: dict) -> dict | None:
        known = state.get("months", {}) if state.get("schema") == shape else {}
        kept = {m: e for m, e in known.items() if e["fingerprint"] == found.get(m)}
        changed = sorted(set(found) - set(kept))
        if state and not changed and kept.keys() == known.keys():
            return None
        folder = f"data/{uuid.uuid4().hex}"
        if changed:
            dated = df.withColumn(_MONTH, _month(month_of)).where(F.col(_MONTH).isin(changed))
            # Rebalanced by month: few files in each, and a large month is split.
            spread = dated.hint("rebalance", _MONTH).write.partitionBy(_MONTH)
            spread.parquet(f"{path}/{folder}")
        new = {m: {"fingerprint": found[m], "folder": folder} for m in changed}
        return {"schema": shape, "months": {**kept, **new}}

    version = CommitLog(spark, f"{path}/_log").update(write)
    return read_months(spark, path, version)


def read_months(
    spark: SparkSession, path: str, version: int | None = None, with_folder: bool = False
) -> DataFrame:
    """The table that :func:`sink_months` stored, as of a version (the latest by default).

    ``with_folder`` adds ``_folder``, which tells the runs apart that wrote a row.
    """
    _, state = CommitLog(spark, f"{path}/_log").read(version)
    if not state:
        raise ValueError(f"{path} holds no committed table")
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{path}/{e['folder']}/{_MONTH}={month}" for month, e in sorted(state["months"].items())]
    if not paths:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(*paths)
    if with_folder:
        folder = F.regexp_extract(F.input_file_name(), rf"/data/([0-9a-f]+)/{_MONTH}=", 1)
        table = table.withColumn("_folder", folder)
    return table


def month_parts(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The months of a table of :func:`sink_months`, named by folder and month.

    A name stands for the same rows for ever, as a changed month gets a new folder.
    """
    _, state = CommitLog(spark, f"{path}/_log").read(version)
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    places = [f"{e['folder']}/{_MONTH}={m}" for m, e in sorted(state.get("months", {}).items())]
    return {p: spark.read.schema(schema).parquet(f"{path}/{p}") for p in places}


def build_warehouse(
    spark: SparkSession,
    raw: Callable[[str], DataFrame],
    env: str = "dev",
    models: list[str] | None = None,
    as_of: str | None = None,
    comments: dict[str, dict[str, str]] | None = None,
    buckets: int | None = None,
) -> Warehouse:
    """Build models layer by layer, each from the stored copy of the ones before.

    Staging and most marts become views, dimensions, facts and segments tables, in one
    database per layer and environment. With ``buckets``, facts joined on the order id are bucketed
    on it; without, they are partitioned by month where they have a purchase date, and joins stay
    shuffles that Spark can split (the choice where one order may outweigh a bucket).
    """
    warehouse = Warehouse(raw, as_of=as_of)
    for name in models or list(MODELS):
        model = MODELS[name]
        stored = sink_table(
            warehouse.get(name),
            name,
            schema_name_for_env(model.layer, env),
            model.stored,
            model.bucket_by if buckets else None,
            buckets,
            (comments or {}).get(name),
            None if buckets and model.bucket_by else model.month_of,
        )
        if model.month_of and f"{model.month_of}_month" in stored.columns:
            # The extra column serves the storage only.
            stored = stored.drop(f"{model.month_of}_month")
        warehouse.put(name, stored)
    return warehouse


def _has_own_limit(result: DataFrame) -> bool:
    """Whether the outermost step of the parsed query is a limit."""
    plan = result._jdf.queryExecution().analyzed()
    while plan.nodeName() == "WithCTE":
        plan = plan.plan()
    return plan.nodeName() in ("GlobalLimit", "LocalLimit")


def run_sql(spark: SparkSession, text: str, default_limit: int = 20) -> DataFrame:
    """Run one SELECT on the registered models; without a limit of its own it is capped.

    One trailing semicolon is dropped. The text must parse as a subquery, where nothing but a
    query can stand; anything else is refused before it runs. Only a limit of the whole
    query lifts the cap, not one in a literal, a comment or a subquery.
    """
    text = text.strip().removesuffix(";").strip()
    try:
        spark.sql(f"select * from (\n{text}\n) as _query")
        result = spark.sql(f"(\n{text}\n)")
    except ParseException as error:
        raise ValueError("only SELECT statements are accepted") from error
    return result if _has_own_limit(result) else result.limit(default_limit)
