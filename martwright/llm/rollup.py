"""Token counts as rollups maintained by signed deltas.

A batch states the new count of some documents under a tokenizer version, or that they are gone.
Against the ledger of earlier batches every change becomes signed rows: the old count is taken back
and the new one added. The signed rows extend the ledger, and their sums by source, language and
tokenizer are the batch's delta; totals are the sum of all deltas, so an old document is never
counted again.

Commits: a batch is written below a fresh name and becomes part of the rollup by one small log
entry, moved into place as the next version. A batch that is already in the log is left alone, so
a repeated commit changes nothing; files of a commit that failed half-way are never read. A
writer that loses a version to another one reads the log again and repeats its work against it.

Defined results: several changes of one document and tokenizer in a batch count as one, the one
with the largest values (a removal only if it is alone); removing an unknown document changes
nothing; null source and language are groups of their own; changes without document or tokenizer
are refused by leaving them out, as no later batch could take them back. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.tokens import encoder

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, docs long, tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Totals kept below ``folder``, a place that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self) -> list[dict]:
        """Committed batches in order."""
        log = self._path(f"{self.folder}/log")
        if not self._files.exists(log):
            return []
        names = sorted(
            status.getPath().getName()
            for status in self._files.listStatus(log)
            if status.getPath().getName().endswith(".json")
        )
        return [json.loads(self._read(f"{self.folder}/log/{name}")) for name in names]

    def _read(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _enter(self, version: int, entry: dict) -> bool:
        """Make ``entry`` the log's next version; False if another writer was first."""
        target = self._path(f"{self.folder}/log/{version:020d}.json")
        draft = self._path(f"{self.folder}/drafts/{entry['attempt']}")
        self._files.mkdirs(target.getParent())
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return not self._files.exists(target) and self._files.rename(draft, target)

    def _parts(self, kind: str, schema: str, log: list[dict]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{kind}/{entry['attempt']}" for entry in log]
        return self.spark.read.schema(schema).parquet(*paths)

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``docs`` and ``tokens`` of all groups not empty."""
        deltas = self._parts("deltas", DELTA, self._log())
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def documents(self) -> DataFrame:
        """The count of every document, as the ledger adds up to."""
        return self._standing(self._log())

    def _standing(self, log: list[dict]) -> DataFrame:
        signed = self._parts("ledger", LEDGER, log)
        sums = signed.groupBy("doc_id", "tokenizer", "source", "lang").agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
        )
        return sums.where(F.col("docs") > 0)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before.

        ``changes`` has doc_id, tokenizer, source, lang and tokens; null tokens remove a document.
        """
        new = (
            changes.select("doc_id", "tokenizer", "source", "lang", F.col("tokens").cast("long"))
            .where(F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull())
            .groupBy("doc_id", "tokenizer")
            .agg(F.max(F.struct("tokens", "source", "lang")).alias("new"))
        )
        while True:
            log = self._log()
            if any(entry["batch"] == batch for entry in log):
                return False
            attempt = uuid.uuid4().hex
            old = self._standing(log).select(
                F.col("doc_id").alias("_doc"),
                F.col("tokenizer").alias("_tokenizer"),
                F.struct("docs", "tokens", "source", "lang").alias("old"),
            )
            same = (F.col("doc_id") == F.col("_doc")) & (F.col("tokenizer") == F.col("_tokenizer"))
            taken = F.struct(
                F.col("old.source").alias("source"),
                F.col("old.lang").alias("lang"),
                (-F.col("old.docs")).alias("docs"),
                (-F.col("old.tokens")).alias("tokens"),
            )
            given = F.struct(
                F.col("new.source").alias("source"),
                F.col("new.lang").alias("lang"),
                F.lit(1).cast("long").alias("docs"),
                F.col("new.tokens").alias("tokens"),
            )
            rows = F.array_compact(
                F.array(
                    F.when(F.col("old").isNotNull(), taken),
                    F.when(F.col("new.tokens").isNotNull(), given),
                )
            )
            signed = (
                new.join(old, same, "left")
                .select("doc_id", "tokenizer", F.explode(rows).alias("row"))
                .select("doc_id", "tokenizer", "row.*")
                .groupBy("doc_id", "tokenizer", "source", "lang")
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where((F.col("docs") != 0) | (F.col("tokens") != 0))
            )
            signed.write.parquet(f"{self.folder}/ledger/{attempt}")
            written = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{attempt}")
            written.groupBy(*GROUP).agg(
                F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
            ).write.parquet(f"{self.folder}/deltas/{attempt}")
            if self._enter(len(log), {"batch": batch, "attempt": attempt}):
                return True


def token_counts(docs: DataFrame, vocabularies: dict[str, str], text: str = "text") -> DataFrame:
    """``row`` (all columns of a document) and ``counts``, its tokens by tokenizer version.

    ``vocabularies`` maps a version to its vocabulary file.
    """

    @F.pandas_udf("map<string,long>")
    def count(texts: pd.Series) -> pd.Series:
        encoders = {version: encoder(path) for version, path in vocabularies.items()}
        return pd.Series(
            [
                {version: len(encode(whole or "")) for version, encode in encoders.items()}
                for whole in texts
            ],
            dtype=object,
        )

    return docs.select(F.struct("*").alias("row"), count(F.col(text)).alias("counts"))
