"""The model graph: which function builds a model, from what, and how it is stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from martwright.plans import core, marts, staging


@dataclass(frozen=True)
class Model:
    """``stored`` is ``view`` or ``table``.

    ``bucket_by`` co-locates tables joined on it; ``month_of`` is the date a stored table can be
    partitioned by.
    """

    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    layer: str
    stored: str
    bucket_by: str | None = None
    month_of: str | None = None
    dated: bool = False


def _staging(name: str, raw: str) -> Model:
    return Model(getattr(staging, name), (raw,), "staging", "view")


def _core(
    name: str,
    *inputs: str,
    bucket_by: str | None = None,
    month_of: str | None = None,
    dated: bool = False,
) -> Model:
    build = getattr(core, name)
    return Model(build, inputs, "intermediate", "table", bucket_by, month_of, dated)


def _mart(name: str, *inputs: str, stored: str = "view") -> Model:
    return Model(getattr(marts, name), inputs, "analytics", stored)


MODELS: dict[str, Model] = {
    "stg_orders": _staging("stg_orders", "raw_orders"),
    "stg_order_items": _staging("stg_order_items", "raw_order_items"),
    "stg_order_payments": _staging("stg_order_payments", "raw_order_payments"),
    "stg_reviews": _staging("stg_reviews", "raw_order_reviews"),
    "stg_customers": _staging("stg_customers", "raw_customers"),
    "stg_geolocation": _staging("stg_geolocation", "raw_geolocation"),
    "stg_products": _staging("stg_products", "raw_products"),
    "stg_product_category_translation": _staging(
        "stg_product_category_translation", "raw_category_translation"
    ),
    "stg_sellers": _staging("stg_sellers", "raw_sellers"),
    "stg_marketing_qualified_leads": _staging(
        "stg_marketing_qualified_leads", "raw_marketing_qualified_leads"
    ),
    "stg_closed_deals": _staging("stg_closed_deals", "raw_closed_deals"),
    "dim_customers": _core("dim_customers", "stg_customers", "stg_geolocation"),
    "dim_sellers": _core("dim_sellers", "stg_sellers", "stg_geolocation"),
    "dim_products": _core("dim_products", "stg_products", "stg_product_category_translation"),
    "dim_location": _core("dim_location", "stg_geolocation", dated=True),
    "dim_date": _core("dim_date", "stg_orders"),
    "fact_orders": _core(
        "fact_orders",
        "stg_orders",
        "stg_order_items",
        "stg_order_payments",
        "stg_reviews",
        "dim_customers",
        bucket_by="order_id",
        month_of="order_purchase_datetime",
    ),
    "fact_order_lines": _core(
        "fact_order_lines",
        "stg_order_items",
        "stg_orders",
        "stg_reviews",
        bucket_by="order_id",
    ),
    "fact_payments": _core(
        "fact_payments", "stg_order_payments", "stg_orders", month_of="payment_date", dated=True
    ),
    "fact_reviews": _core(
        "fact_reviews", "stg_reviews", "stg_orders", month_of="review_date", dated=True
    ),
    "fact_closed_deals": _core(
        "fact_closed_deals", "stg_closed_deals", "stg_marketing_qualified_leads"
    ),
    "fact_product_daily_metrics": _core(
        "fact_product_daily_metrics",
        "fact_order_lines",
        "fact_orders",
        month_of="order_date",
        dated=True,
    ),
    "bridge_product_seller": _core("bridge_product_seller", "fact_order_lines", "fact_orders"),
    "agg_daily_sales": _core("agg_daily_sales", "fact_orders"),
    "order_details_wide": _mart("order_details_wide", "fact_order_lines", "fact_orders"),
    "agg_customer_performance": _mart("agg_customer_performance", "fact_orders"),
    "customer_segments": _mart("customer_segments", "agg_customer_performance", stored="table"),
    "agg_customer_churn_risk": _mart("agg_customer_churn_risk", "fact_orders"),
    "agg_customer_repurchase_metrics": _mart("agg_customer_repurchase_metrics", "fact_orders"),
    "agg_seller_performance": _mart(
        "agg_seller_performance", "fact_order_lines", "fact_orders"
    ),
    "agg_seller_health_scorecard": _mart(
        "agg_seller_health_scorecard", "fact_order_lines", "fact_orders"
    ),
    "agg_product_quality_metrics": _mart(
        "agg_product_quality_metrics", "fact_order_lines", "fact_orders"
    ),
    "agg_marketing_channel_performance": _mart(
        "agg_marketing_channel_performance",
        "stg_marketing_qualified_leads",
        "fact_closed_deals",
    ),
    "mql_details_wide": _mart("mql_details_wide", "fact_closed_deals", "agg_seller_performance"),
}


class Warehouse:
    """Models over raw tables, each built lazily and once.

    ``raw`` gives the raw table of a name. ``as_of`` fixes the load time written into
    ``created_at``; without it the current time is used.
    """

    def __init__(self, raw: Callable[[str], DataFrame], as_of: str | None = None):
        self._raw = raw
        self._as_of = as_of
        self._frames: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name not in MODELS:
            return self._raw(name)
        model = MODELS[name]
        options = {"as_of": self._as_of} if model.dated else {}
        return model.build(*map(self.get, model.inputs), **options)

    def put(self, name: str, frame: DataFrame) -> None:
        """Use a stored copy of a model for everything built on it."""
        self._frames[name] = frame
