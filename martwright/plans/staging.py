"""Staging: rename, clean, and drop rows without a key. One function per raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions import (
    clean_label,
    initcap_words,
    lead_channel,
    lead_tier,
    standardize_to_datetime,
)


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key columns are all present."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def stg_orders(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "order_id", "customer_id").select(
        "order_id",
        F.col("customer_id").alias("order_customer_id"),
        initcap_words("order_status").alias("order_status"),
        F.col("order_purchase_timestamp").alias("order_purchase_datetime"),
        F.col("order_approved_at").alias("order_approved_datetime"),
        F.col("order_delivered_carrier_date").alias("order_delivered_carrier_datetime"),
        F.col("order_delivered_customer_date").alias("order_delivered_customer_datetime"),
        F.col("order_estimated_delivery_date").alias("order_estimated_delivery_datetime"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "order_id", "product_id").select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("shipping_limit_date").alias("shipping_limit_datetime"),
        F.col("price").alias("item_price"),
        F.col("freight_value").alias("item_freight_value"),
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    installments = F.col("payment_installments")
    return _keyed(raw, "order_id").select(
        "order_id",
        F.col("payment_sequential").alias("payment_type_sequence"),
        clean_label("payment_type").alias("payment_type"),
        F.when(installments == 0, 1).otherwise(installments).alias("payment_installment_count"),
        "payment_value",
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "review_id", "order_id").select(
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        F.col("review_creation_date").alias("review_creation_datetime"),
        F.col("review_answer_timestamp").alias("review_answer_datetime"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    """``customer_id`` becomes the person, the per-order id moves to ``order_customer_id``."""
    return _keyed(raw, "customer_unique_id", "customer_id").select(
        F.col("customer_unique_id").alias("customer_id"),
        F.col("customer_id").alias("order_customer_id"),
        F.col("customer_zip_code_prefix").alias("customer_zip_code"),
        initcap_words("customer_city").alias("customer_city"),
        F.upper("customer_state").alias("customer_state"),
    )


def stg_geolocation(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "geolocation_zip_code_prefix").select(
        F.col("geolocation_zip_code_prefix").alias("zip_code"),
        initcap_words("geolocation_city").alias("city"),
        F.upper("geolocation_state").alias("state"),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "product_id").select(
        "product_id",
        clean_label("product_category_name").alias("product_category"),
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_photos_qty",
        F.col("product_weight_g").alias("product_weight_gm"),
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def stg_product_category_translation(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "product_category_name").select(
        clean_label("product_category_name").alias("product_category_name"),
        clean_label("product_category_name_english").alias("product_category_name_english"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    """The state is capitalised here but upper-cased for customers; both are kept as they are."""
    return _keyed(raw, "seller_id").select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("seller_zip_code"),
        initcap_words("seller_city").alias("seller_city"),
        initcap_words("seller_state").alias("seller_state"),
    )


def stg_marketing_qualified_leads(raw: DataFrame) -> DataFrame:
    return _keyed(raw, "mql_id").select(
        "mql_id",
        F.col("first_contact_date").cast("date").alias("mql_first_contact_date"),
        F.col("landing_page_id").alias("mql_landing_page_id"),
        clean_label("origin").alias("mql_origin_category"),
    )


def stg_closed_deals(raw: DataFrame) -> DataFrame:
    lead_type = F.col("lead_type")
    return _keyed(raw, "mql_id", "seller_id").select(
        "mql_id",
        "seller_id",
        "sdr_id",
        "sr_id",
        standardize_to_datetime("won_date").alias("deal_closed_datetime"),
        clean_label("business_segment").alias("lead_business_segment"),
        lead_channel(lead_type).alias("lead_business_channel_category"),
        lead_tier(lead_type).alias("lead_business_tier"),
        initcap_words("lead_behaviour_profile").alias("lead_behaviour_profile_category"),
        "has_company",
        "has_gtin",
        F.col("average_stock").alias("lead_business_average_stock"),
        initcap_words("business_type").alias("lead_business_category"),
        F.col("declared_product_catalog_size").alias("lead_business_product_catalog_size"),
        F.col("declared_monthly_revenue").alias("lead_business_monthly_revenue"),
    )
