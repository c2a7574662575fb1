"""Model descriptions kept as YAML files, and the store of document vectors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from martwright.operators.documents import incremental_dedupe
from martwright.sources.commits import CommitLog

DOC_SCHEMA = (
    "file_path string, model_name string, description string, column_pos int, "
    "column_name string, column_description string"
)


def _models_of(text: str) -> list[dict]:
    """The named models of one description file; none if it cannot be read as such."""
    import yaml

    try:
        content = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    models = content.get("models") if isinstance(content, dict) else None
    return [m for m in models or [] if isinstance(m, dict) and "name" in m]


def _rows_of(path: str, text: str) -> Iterator[tuple]:
    for model in _models_of(text):
        name, description = str(model["name"]), str(model.get("description", ""))
        columns = [c for c in model.get("columns") or [] if isinstance(c, dict) and "name" in c]
        if not columns:
            yield path, name, description, 0, None, None
        for position, column in enumerate(columns):
            yield (
                path,
                name,
                description,
                position,
                str(column["name"]),
                str(column.get("description", "")),
            )


def read_doc_catalog(
    spark: SparkSession, folder: str, pattern: str = "*.{yml,yaml}"
) -> DataFrame:
    """One row per described column of every description file below ``folder``.

    A model without columns gives one row without a column. A description file is small and
    read as one value; the files are spread over the tasks.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in DOC_SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["value"]) for r in _rows_of(path, text)]
            yield pd.DataFrame(rows, columns=names)

    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .selectExpr("_metadata.file_path as path", "value")
        .mapInPandas(parse, DOC_SCHEMA)
    )


def column_comments(catalog: DataFrame) -> dict[str, dict[str, str]]:
    """Column descriptions by model, as the table builder takes them.

    This is metadata of the size of the description files.
    """
    comments: dict[str, dict[str, str]] = {}
    for row in catalog.where("column_name is not null").collect():
        comments.setdefault(row["model_name"], {})[row["column_name"]] = row["column_description"]
    return comments


def _log(spark: SparkSession, store: str) -> CommitLog:
    return CommitLog(spark, f"{store}/_log")


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame | None:
    """The documents of a store as of a version (the latest by default), None before the first."""
    return _read_parts(spark, store, _log(spark, store).read(version)[1])


def _read_parts(spark: SparkSession, store: str, state: dict) -> DataFrame | None:
    if not state.get("parts"):
        return None
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    return spark.read.schema(schema).parquet(*[f"{store}/{part}" for part in state["parts"]])


def _with_columns_of(state: dict, docs: DataFrame) -> str:
    """The store's columns, followed by those that the documents bring along."""
    fields = T.StructType.fromJson(json.loads(state["schema"])).fields if state else []
    known = {f.name for f in fields}
    return T.StructType(fields + [f for f in docs.schema if f.name not in known]).json()


def vector_upsert(docs: DataFrame, store: str, key: str = "doc_id") -> DataFrame:
    """Add the documents whose id the store lacks, and return the store.

    The store is a folder of parquet parts and a log of versions; :func:`read_store` reads a version,
    where a plain read of the folder also sees parts that no version names. The new documents become visible by
    one commit. If another writer commits first, they are compared with the store again, so no
    writer, failed or overtaken, leaves half a batch or an id twice.
    """
    spark = docs.sparkSession

    def add(state: dict) -> dict | None:
        stored = _read_parts(spark, store, state)
        known = docs.select(key).limit(0) if stored is None else stored.select(key)
        part = f"part={uuid.uuid4().hex}"
        incremental_dedupe(docs, known, key).write.parquet(f"{store}/{part}")
        written = spark.read.schema(docs.schema).parquet(f"{store}/{part}")
        if stored is not None and written.isEmpty():
            return None
        return {"schema": _with_columns_of(state, docs), "parts": [*state.get("parts", []), part]}

    version = _log(spark, store).update(add)
    return read_store(spark, store, version)


def compact(spark: SparkSession, store: str, files: int | None = None) -> DataFrame | None:
    """Bring the parts of the latest version together in one, of so many files if given.

    Parts that others add meanwhile stay; older versions stay readable.
    """
    log = _log(spark, store)
    _, state = log.read()
    old = state.get("parts", [])
    whole = _read_parts(spark, store, state)
    if len(old) < 2:
        return whole
    part = f"part={uuid.uuid4().hex}"
    (whole.repartition(files) if files else whole).write.parquet(f"{store}/{part}")

    def swap(state: dict) -> dict | None:
        now = state["parts"]
        if now[: len(old)] != old:  # compacted by another writer
            return None
        return {**state, "parts": [part, *now[len(old) :]]}

    return read_store(spark, store, log.update(swap))
