"""Canonical raw tables: names, columns and types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS, _DATE, _MONEY = T.TimestampNTZType(), T.DateType(), T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "raw_orders": _schema(
        order_id=_S,
        customer_id=_S,
        order_status=_S,
        order_purchase_timestamp=_TS,
        order_approved_at=_TS,
        order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS,
        order_estimated_delivery_date=_TS,
    ),
    "raw_order_items": _schema(
        order_id=_S,
        order_item_id=_I,
        product_id=_S,
        seller_id=_S,
        shipping_limit_date=_TS,
        price=_MONEY,
        freight_value=_MONEY,
    ),
    "raw_order_payments": _schema(
        order_id=_S,
        payment_sequential=_I,
        payment_type=_S,
        payment_installments=_I,
        payment_value=_MONEY,
    ),
    "raw_order_reviews": _schema(
        review_id=_S,
        order_id=_S,
        review_score=_I,
        review_comment_title=_S,
        review_comment_message=_S,
        review_creation_date=_TS,
        review_answer_timestamp=_TS,
    ),
    "raw_customers": _schema(
        customer_id=_S,
        customer_unique_id=_S,
        customer_zip_code_prefix=_I,
        customer_city=_S,
        customer_state=_S,
    ),
    "raw_geolocation": _schema(
        geolocation_zip_code_prefix=_I, geolocation_city=_S, geolocation_state=_S
    ),
    "raw_products": _schema(
        product_id=_S,
        product_category_name=_S,
        product_name_lenght=_I,
        product_description_lenght=_I,
        product_photos_qty=_I,
        product_weight_g=_I,
        product_length_cm=_I,
        product_height_cm=_I,
        product_width_cm=_I,
    ),
    "raw_category_translation": _schema(
        product_category_name=_S, product_category_name_english=_S
    ),
    "raw_sellers": _schema(
        seller_id=_S, seller_zip_code_prefix=_I, seller_city=_S, seller_state=_S
    ),
    "raw_marketing_qualified_leads": _schema(
        mql_id=_S, first_contact_date=_DATE, landing_page_id=_S, origin=_S
    ),
    "raw_closed_deals": _schema(
        mql_id=_S,
        seller_id=_S,
        sdr_id=_S,
        sr_id=_S,
        won_date=_S,
        business_segment=_S,
        lead_type=_S,
        lead_behaviour_profile=_S,
        has_company=_B,
        has_gtin=_B,
        average_stock=_S,
        business_type=_S,
        declared_product_catalog_size=_D,
        declared_monthly_revenue=_MONEY,
    ),
}
