"""Column functions shared by the plans and operators."""

from martwright.functions.dates import (
    clean_datetime_string,
    day_of,
    hours_between,
    seconds_between,
    standardize_to_datetime,
    whole_days_between,
)
from martwright.functions.numbers import (
    count_when,
    ladder,
    money,
    quotient,
    r2,
    sum_when,
)
from martwright.functions.texts import (
    ascii_clean,
    ascii_clean_columns,
    clean_label,
    initcap_words,
)
from martwright.functions.labels import lead_channel, lead_tier, recency_status

__all__ = [
    "ascii_clean",
    "ascii_clean_columns",
    "clean_datetime_string",
    "clean_label",
    "count_when",
    "day_of",
    "hours_between",
    "initcap_words",
    "ladder",
    "lead_channel",
    "lead_tier",
    "money",
    "quotient",
    "r2",
    "recency_status",
    "seconds_between",
    "standardize_to_datetime",
    "sum_when",
    "whole_days_between",
]
