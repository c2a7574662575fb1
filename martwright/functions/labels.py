"""Business classifications shared by several models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martwright.functions.numbers import ladder

# Lead types and the size tier each one stands for.
LEAD_TIERS = {
    "online_beginner": "Beginner",
    "online_small": "Small",
    "online_medium": "Medium",
    "online_big": "Big",
    "online_top": "Top",
    "other": "Other",
    "industry": "Industry",
}

# Days since the last order, upper bound included.
RECENCY_STATUS = [(30, "Active"), (90, "At Risk"), (180, "Churning")]


def lead_channel(lead_type: Column) -> Column:
    return F.when(lead_type.startswith("online"), F.lit("Online")).when(
        lead_type == "offline", F.lit("Offline")
    )


def lead_tier(lead_type: Column) -> Column:
    chain = None
    for key, tier in LEAD_TIERS.items():
        hit = lead_type == key
        chain = F.when(hit, F.lit(tier)) if chain is None else chain.when(hit, F.lit(tier))
    return chain


def recency_status(days: Column) -> Column:
    return ladder(days, RECENCY_STATUS, "Churned", op="<=")
