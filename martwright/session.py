"""Session settings the plans rely on."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Joins are split where a key outweighs the others, even if that costs a shuffle further on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Shuffled bytes that one task is given. Rows are packed and compressed in a shuffle; the sorts and hash
# tables of joins and aggregations that follow each other in a task take up to 60 times as much.
TASK_INPUT = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
TASK_INPUT_BYTES = 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # A smaller size that was set before is kept.
    if _bytes(spark.conf.get(TASK_INPUT)) > TASK_INPUT_BYTES:
        spark.conf.set(TASK_INPUT, str(TASK_INPUT_BYTES))
    return spark


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the jobs started inside; the one before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a write started inside are removed at its end.

    Otherwise they stay until the driver's garbage collector meets their owners, so the disk holds those
    of all writes before.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
