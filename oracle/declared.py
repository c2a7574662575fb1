"""The checks declared for the models, stated once more for the expected results."""

# Columns that must have a value.
NOT_NULL = """
stg_customers.customer_id stg_geolocation.zip_code stg_geolocation.city stg_geolocation.state
stg_marketing_qualified_leads.mql_id stg_order_items.item_price
stg_order_items.item_freight_value stg_order_payments.payment_value stg_orders.order_id
stg_orders.order_status stg_orders.order_purchase_datetime stg_products.product_id
stg_reviews.review_id stg_reviews.review_score stg_sellers.seller_id dim_customers.customer_id
dim_date.calendar_date dim_location.zip_code dim_products.product_id dim_sellers.seller_id
fact_orders.order_id fact_orders.order_item_price_total fact_orders.order_freight_total
fact_orders.order_total fact_orders.review_count fact_orders.order_purchase_datetime
fact_order_lines.order_id fact_order_lines.order_item_id fact_order_lines.item_price
fact_order_lines.item_freight_value fact_payments.order_id fact_payments.payment_id
fact_payments.payment_type_sequence fact_payments.payment_type fact_payments.payment_value
fact_payments.payment_installment_count fact_payments.payment_date fact_reviews.review_id
fact_reviews.order_id fact_reviews.customer_id fact_reviews.review_score
fact_reviews.review_date fact_closed_deals.mql_id fact_product_daily_metrics.product_id
fact_product_daily_metrics.order_date bridge_product_seller.product_id
bridge_product_seller.seller_id bridge_product_seller.first_sale_date
bridge_product_seller.last_sale_date bridge_product_seller.total_orders
bridge_product_seller.total_line_items bridge_product_seller.total_revenue
bridge_product_seller.total_freight_cost bridge_product_seller.total_revenue_with_freight
bridge_product_seller.avg_item_price agg_daily_sales.order_date order_details_wide.order_id
order_details_wide.order_item_id agg_customer_performance.customer_id
agg_customer_churn_risk.customer_id agg_customer_repurchase_metrics.customer_id
agg_seller_performance.seller_id agg_seller_health_scorecard.seller_id
agg_product_quality_metrics.product_id agg_marketing_channel_performance.channel
mql_details_wide.mql_id mql_details_wide.seller_id
""".split()

# Columns without repeated values.
UNIQUE = """
stg_marketing_qualified_leads.mql_id stg_orders.order_id stg_products.product_id
stg_sellers.seller_id dim_date.calendar_date dim_products.product_id dim_sellers.seller_id
fact_payments.payment_id fact_closed_deals.mql_id agg_daily_sales.order_date
agg_customer_performance.customer_id agg_customer_churn_risk.customer_id
agg_customer_repurchase_metrics.customer_id agg_seller_performance.seller_id
agg_seller_health_scorecard.seller_id agg_product_quality_metrics.product_id
agg_marketing_channel_performance.channel mql_details_wide.mql_id
""".split()

# Columns whose values must occur in another one.
RELATED = """
dim_location.zip_code stg_geolocation.zip_code
fact_payments.order_id stg_orders.order_id
fact_reviews.review_id stg_reviews.review_id
fact_reviews.order_id stg_orders.order_id
fact_product_daily_metrics.product_id stg_products.product_id
order_details_wide.order_id fact_orders.order_id
agg_customer_performance.customer_id fact_orders.customer_id
agg_customer_churn_risk.customer_id fact_orders.customer_id
agg_customer_repurchase_metrics.customer_id fact_orders.customer_id
agg_seller_health_scorecard.seller_id stg_sellers.seller_id
agg_product_quality_metrics.product_id stg_products.product_id
""".strip().splitlines()

# Columns that must not be negative, must be at least one, or are scores from 1 to 5.
NOT_NEGATIVE = """
stg_order_items.item_price stg_order_items.item_freight_value stg_order_payments.payment_value
fact_orders.order_item_price_total fact_orders.order_freight_total fact_orders.order_total
fact_orders.review_count fact_order_lines.item_price fact_order_lines.item_freight_value
fact_payments.payment_value bridge_product_seller.total_revenue
bridge_product_seller.total_freight_cost bridge_product_seller.total_revenue_with_freight
bridge_product_seller.avg_item_price bridge_product_seller.days_since_last_sale
""".split()
AT_LEAST_ONE = """
fact_payments.payment_type_sequence fact_payments.payment_installment_count
bridge_product_seller.total_orders bridge_product_seller.total_line_items
""".split()
SCORES = """
stg_reviews.review_score fact_orders.avg_review_score fact_orders.max_review_score
fact_orders.min_review_score fact_order_lines.review_score fact_reviews.review_score
bridge_product_seller.avg_review_score
""".split()
