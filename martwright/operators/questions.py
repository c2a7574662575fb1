"""Classification of questions and extraction of SQL from answers, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A text holding any of these is a request for SQL.
SQL_WORDS = ["sql", "query", "select", "from", "write a query", "show me the query"]

# Patterns of each intent; the order of intents decides the primary one.
INTENT_PATTERNS: dict[str, list[str]] = {
    "trend": [
        r"\b(trend|over time|time series|historical|change|growth|decline)\b",
        r"\b(daily|weekly|monthly|yearly|year|month|day)\b",
        r"\b(progression|evolution|development)\b",
    ],
    "comparison": [
        r"\b(compare|vs|versus|difference|between)\b",
        r"\b(by category|by type|by group|across)\b",
        r"\b(which.*better|which.*more|which.*less)\b",
    ],
    "distribution": [
        r"\b(distribution|spread|range|frequency|histogram)\b",
        r"\b(how many|count of|number of)\b",
        r"\b(breakdown|split)\b",
    ],
    "ranking": [
        r"\b(top|bottom|best|worst|highest|lowest)\b",
        r"\b(rank|ranking|order by)\b",
        r"\b(most|least)\b",
    ],
    "composition": [
        r"\b(composition|makeup|proportion|percentage|share)\b",
        r"\b(part of|portion|segment)\b",
        r"\b(contribute|contribution)\b",
    ],
    "relationship": [
        r"\b(relationship|correlation|connection|related)\b",
        r"\b(impact|affect|influence)\b",
        r"\b(depend|depends on)\b",
    ],
    "aggregation": [
        r"\b(total|sum|average|mean|count|aggregate)\b",
        r"\b(revenue|sales|profit|value)\b",
    ],
}

# Word boundaries see accented letters, and a dot stops at a line feed only.
_FLAGS = "(?Ud)"


def classify_sql_request(text: Column) -> Column:
    """Whether the text asks for SQL; a plain substring test in any case."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in SQL_WORDS:
        hit = hit | lowered.contains(word)
    return hit


def classify_intents(text: Column) -> Column:
    """All intents found, in their fixed order, or ``unknown``."""
    lowered = F.lower(text)
    found = F.array_compact(
        F.array(
            *[
                F.when(lowered.rlike(_FLAGS + "|".join(patterns)), F.lit(intent))
                for intent, patterns in INTENT_PATTERNS.items()
            ]
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def primary_intent(intents: Column) -> Column:
    return F.get(intents, F.lit(0))


def extract_fenced_sql(text: Column) -> Column:
    """Content of the first block fenced as sql, else the whole text; both trimmed."""
    block = F.regexp_extract(text, r"(?s)```sql\n(.*?)```", 1)
    chosen = F.when(text.rlike(r"(?s)```sql\n.*?```"), block).otherwise(text)
    return F.regexp_replace(chosen, r"(?U)^\s+|\s+\z", "")
