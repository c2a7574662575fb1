"""The checks declared for the models, and a runner for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.operators import quality
from martwright.plans.catalog import Warehouse

# Columns that must have a value, by model.
NOT_NULL: dict[str, str] = {
    "stg_customers": "customer_id",
    "stg_geolocation": "zip_code city state",
    "stg_marketing_qualified_leads": "mql_id",
    "stg_order_items": "item_price item_freight_value",
    "stg_order_payments": "payment_value",
    "stg_orders": "order_id order_status order_purchase_datetime",
    "stg_products": "product_id",
    "stg_reviews": "review_id review_score",
    "stg_sellers": "seller_id",
    "dim_customers": "customer_id",
    "dim_date": "calendar_date",
    "dim_location": "zip_code",
    "dim_products": "product_id",
    "dim_sellers": "seller_id",
    "fact_orders": "order_id order_item_price_total order_freight_total order_total review_count "
    "order_purchase_datetime",
    "fact_order_lines": "order_id order_item_id item_price item_freight_value",
    "fact_payments": "order_id payment_id payment_type_sequence payment_type payment_value "
    "payment_installment_count payment_date",
    "fact_reviews": "review_id order_id customer_id review_score review_date",
    "fact_closed_deals": "mql_id",
    "fact_product_daily_metrics": "product_id order_date",
    "bridge_product_seller": "product_id seller_id first_sale_date last_sale_date total_orders "
    "total_line_items total_revenue total_freight_cost total_revenue_with_freight avg_item_price",
    "agg_daily_sales": "order_date",
    "order_details_wide": "order_id order_item_id",
    "agg_customer_performance": "customer_id",
    "agg_customer_churn_risk": "customer_id",
    "agg_customer_repurchase_metrics": "customer_id",
    "agg_seller_performance": "seller_id",
    "agg_seller_health_scorecard": "seller_id",
    "agg_product_quality_metrics": "product_id",
    "agg_marketing_channel_performance": "channel",
    "mql_details_wide": "mql_id seller_id",
}

# Columns whose values may occur once only.
UNIQUE: dict[str, str] = {
    "stg_marketing_qualified_leads": "mql_id",
    "stg_orders": "order_id",
    "stg_products": "product_id",
    "stg_sellers": "seller_id",
    "dim_date": "calendar_date",
    "dim_products": "product_id",
    "dim_sellers": "seller_id",
    "fact_payments": "payment_id",
    "fact_closed_deals": "mql_id",
    "agg_daily_sales": "order_date",
    "agg_customer_performance": "customer_id",
    "agg_customer_churn_risk": "customer_id",
    "agg_customer_repurchase_metrics": "customer_id",
    "agg_seller_performance": "seller_id",
    "agg_seller_health_scorecard": "seller_id",
    "agg_product_quality_metrics": "product_id",
    "agg_marketing_channel_performance": "channel",
    "mql_details_wide": "mql_id",
}

# Fixed values: (model, column, parent model, parent column).
RELATIONSHIPS: list[tuple[str, str, str, str]] = [
    ("dim_location", "zip_code", "stg_geolocation", "zip_code"),
    ("fact_payments", "order_id", "stg_orders", "order_id"),
    ("fact_reviews", "review_id", "stg_reviews", "review_id"),
    ("fact_reviews", "order_id", "stg_orders", "order_id"),
    ("fact_product_daily_metrics", "product_id", "stg_products", "product_id"),
    ("order_details_wide", "order_id", "fact_orders", "order_id"),
    ("agg_customer_performance", "customer_id", "fact_orders", "customer_id"),
    ("agg_customer_churn_risk", "customer_id", "fact_orders", "customer_id"),
    ("agg_customer_repurchase_metrics", "customer_id", "fact_orders", "customer_id"),
    ("agg_seller_health_scorecard", "seller_id", "stg_sellers", "seller_id"),
    ("agg_product_quality_metrics", "product_id", "stg_products", "product_id"),
]

# Accepted values and inclusive limits (None is open).
ACCEPTED_VALUES = [("fact_orders", "on_time_delivery_flag", [0, 1])]
IN_SET = [("fact_closed_deals", "mql_link_status", ["linked", "orphaned"])]
_SCORE, _FROM_0, _FROM_1 = (1, 5), (0, None), (1, None)
BETWEEN: dict[str, dict[str, tuple[int | None, int | None]]] = {
    "stg_order_items": {"item_price": _FROM_0, "item_freight_value": _FROM_0},
    "stg_order_payments": {"payment_value": _FROM_0},
    "stg_reviews": {"review_score": _SCORE},
    "fact_orders": {
        "order_item_price_total": _FROM_0,
        "order_freight_total": _FROM_0,
        "order_total": _FROM_0,
        "review_count": _FROM_0,
        "avg_review_score": _SCORE,
        "max_review_score": _SCORE,
        "min_review_score": _SCORE,
    },
    "fact_order_lines": {
        "item_price": _FROM_0,
        "item_freight_value": _FROM_0,
        "review_score": _SCORE,
    },
    "fact_payments": {
        "payment_type_sequence": _FROM_1,
        "payment_value": _FROM_0,
        "payment_installment_count": _FROM_1,
    },
    "fact_reviews": {"review_score": _SCORE},
    "bridge_product_seller": {
        "total_orders": _FROM_1,
        "total_line_items": _FROM_1,
        "total_revenue": _FROM_0,
        "total_freight_cost": _FROM_0,
        "total_revenue_with_freight": _FROM_0,
        "avg_item_price": _FROM_0,
        "avg_review_score": _SCORE,
        "days_since_last_sale": _FROM_0,
    },
}

CHECK_COUNT = (
    sum(len(c.split()) for c in (*NOT_NULL.values(), *UNIQUE.values()))
    + len(RELATIONSHIPS)
    + len(ACCEPTED_VALUES)
    + len(IN_SET)
    + sum(map(len, BETWEEN.values()))
)


def _named(model: str, violations: DataFrame) -> DataFrame:
    return violations.select(F.lit(model).alias("model"), "column_name", "value", "failures")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_not_null(wh: Warehouse) -> DataFrame:
    return _all([_named(m, quality.not_null(wh.get(m), c.split())) for m, c in NOT_NULL.items()])


def check_unique(wh: Warehouse) -> DataFrame:
    return _all([_named(m, quality.unique(wh.get(m), c.split())) for m, c in UNIQUE.items()])


def check_relationships(wh: Warehouse) -> DataFrame:
    return _all(
        [
            _named(model, quality.relationships(wh.get(model), column, wh.get(parent), key))
            for model, column, parent, key in RELATIONSHIPS
        ]
    )


def check_accepted_values(wh: Warehouse) -> DataFrame:
    return _all(
        [_named(m, quality.accepted_values(wh.get(m), c, v)) for m, c, v in ACCEPTED_VALUES]
    )


def check_in_set(wh: Warehouse) -> DataFrame:
    return _all([_named(m, quality.in_set(wh.get(m), c, v)) for m, c, v in IN_SET])


def check_between(wh: Warehouse) -> DataFrame:
    return _all([_named(m, quality.between(wh.get(m), limits)) for m, limits in BETWEEN.items()])


def counting_rules() -> dict[str, list[tuple[str, str, Column]]]:
    """Of each model, the checks that a count of its rows decides: (check, column, failing)."""
    rules: dict[str, list[tuple[str, str, Column]]] = {}
    for model, columns in NOT_NULL.items():
        for c in columns.split():
            rules.setdefault(model, []).append(("not_null", c, F.col(c).isNull()))
    for model, limits in BETWEEN.items():
        for c, (low, high) in limits.items():
            rules.setdefault(model, []).append(("between", c, quality.outside(c, low, high)))
    for check, declared in (("accepted_values", ACCEPTED_VALUES), ("in_set", IN_SET)):
        for model, c, values in declared:
            failing = F.coalesce(~F.col(c).isin(values), F.lit(False))
            rules.setdefault(model, []).append((check, c, failing))
    return rules


def check_counts(wh: Warehouse) -> DataFrame:
    """All counting checks with their numbers of rows and failures: one aggregation a model."""
    return _all(
        [
            quality.counted(wh.get(model), rules).select(F.lit(model).alias("model"), "*")
            for model, rules in counting_rules().items()
        ]
    )


def run_all(wh: Warehouse) -> DataFrame:
    """All declared checks in one table, only what fails."""
    parts = {
        "not_null": check_not_null(wh).where(F.col("failures") > 0),
        "unique": check_unique(wh),
        "relationships": check_relationships(wh),
        "accepted_values": check_accepted_values(wh),
        "in_set": check_in_set(wh),
        "between": check_between(wh),
    }
    return _all([df.select(F.lit(kind).alias("check"), "*") for kind, df in parts.items()])
