"""Database names per environment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix of a schema name by environment.
ENV_SUFFIX = {"dev": "_dev", "uat": "_uat"}


def schema_name_for_env(base: str, env: str) -> str:
    return base + ENV_SUFFIX.get(env, "")


def schema_name_column(base: Column, env: Column) -> Column:
    """The same rule for names held in a table."""
    suffix = F.lit("")
    for name, ending in ENV_SUFFIX.items():
        suffix = F.when(env == name, ending).otherwise(suffix)
    return F.concat(base, suffix)
