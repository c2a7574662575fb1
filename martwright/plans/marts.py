"""Marts over the facts.

Seller and product marts reduce the lines per (entity, order) before they meet the orders, so
an order with very many lines is small by then, and once more right after, where that takes no
shuffle. Distinct orders then become plain counts, and only reduced rows travel to the
entity, so an entity owning a third of all lines costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions import (
    count_when,
    day_of,
    ladder,
    money,
    quotient,
    r2,
    recency_status,
    seconds_between,
    sum_when,
)
from martwright.operators.ordering import ntile_scores
from martwright.plans.core import LOST_STATUSES, last_order_day


def _avg(total: Column, count: Column) -> Column:
    return money(r2(quotient(total, count)))


def _lines(condition: Column) -> Column:
    """Lines, held as ``n`` per reduced row, that meet the condition."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _percent(part: Column | str, whole: Column | str) -> Column:
    return money(r2(quotient(part, whole) * 100))


def order_details_wide(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines next to everything known about their order."""
    context = orders.select(
        "order_id",
        "order_status",
        "order_item_count",
        "order_item_price_total",
        "order_freight_total",
        "order_total",
        "payment_count",
        "payment_method_type_count",
        "payment_installment_count",
        "payment_total",
        "avg_review_score",
        "time_to_approval_hours",
        "time_to_ship_hours",
        "time_to_deliver_hours",
        "delivery_estimation_slip_hours",
        "order_purchase_datetime",
        "order_approved_datetime",
        "order_delivered_carrier_datetime",
        "order_delivered_customer_datetime",
        "order_estimated_delivery_datetime",
    )
    line = lines.select(
        "order_id",
        "order_item_id",
        "shipping_limit_datetime",
        "item_price",
        "item_freight_value",
        "review_score",
        "product_id",
        "seller_id",
        F.col("order_customer_id").alias("customer_id"),
    )
    return line.join(context, "order_id", "left")


def agg_customer_performance(orders: DataFrame) -> DataFrame:
    """Value, frequency and recency per customer over all order states."""
    day, total = day_of("order_purchase_datetime"), F.col("order_total")
    status, score = F.col("order_status"), F.col("avg_review_score")
    lifetime = F.datediff(F.max(day), F.min(day))
    grouped = orders.groupBy("customer_id").agg(
        F.min(day).alias("first_purchase_date"),
        F.max(day).alias("last_purchase_date"),
        lifetime.alias("customer_lifetime_days"),
        money(F.sum(total)).alias("life_time_customer_value"),
        _avg(F.sum(total), F.count(total)).alias("avg_order_value"),
        F.count("order_id").alias("total_order_count"),
        count_when(status == "Canceled").alias("canceled_order_count"),
        count_when(status == "Unavailable").alias("unavailable_order_count"),
        money(sum_when(status == "Canceled", "payment_total")).alias("lost_revenue_canceled"),
        money(sum_when(status == "Unavailable", "payment_total")).alias(
            "lost_revenue_unavailable"
        ),
        _avg(F.sum(score), F.count(score)).alias("avg_review_score"),
        money(r2(quotient(F.count("order_id"), lifetime) * 30)).alias("avg_monthly_orders"),
        money(r2(quotient(F.sum(total), lifetime) * 30)).alias("avg_monthly_spend"),
        _percent(count_when(status.isin(LOST_STATUSES)), F.count("order_id")).alias(
            "problem_order_rate"
        ),
        money(r2(F.stddev_samp(total.cast("double")))).alias("order_value_stddev"),
        _percent(count_when(score >= 4), F.count(score)).alias("positive_review_rate"),
    )
    since = F.datediff(last_order_day(orders), "last_purchase_date")
    return grouped.select(
        "customer_id",
        "first_purchase_date",
        "last_purchase_date",
        since.alias("days_since_last_purchase"),
        *grouped.columns[3:],
        recency_status(since).alias("customer_status"),
        # One-day customers have no monthly spend and count as low value.
        ladder(
            "avg_monthly_spend", [(1000, "High Value"), (500, "Medium Value")], "Low Value"
        ).alias("customer_value_tier"),
    )


def segment_label(r: Column, f: Column, m: Column) -> Column:
    """Segment of three tile scores, first match wins."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "High-Value Loyal")
        .when((r >= 4) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2) & (m <= 2), "New Customers")
        .when((r <= 2) & (f >= 4) & (m >= 4), "At-Risk Loyal")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Churned / Lost")
        .when((r >= 3) & (f <= 2) & (m >= 3), "Promising")
        .when((r <= 2) & (f >= 3) & (m <= 2), "Needs Attention")
        .otherwise("Other")
    )


def customer_segments(performance: DataFrame, invert: bool = False) -> DataFrame:
    """Recency, frequency and monetary quintiles with a segment label.

    As defined, tile 1 is the best customers, although the labels read 5 as best.
    ``invert=True`` turns the scores round.
    """
    scored = ntile_scores(
        performance,
        "customer_id",
        {
            "r_score": ("days_since_last_purchase", True),
            "f_score": ("total_order_count", False),
            "m_score": ("life_time_customer_value", False),
        },
    )
    if invert:
        scored = scored.select(
            "customer_id", *[(6 - F.col(c)).alias(c) for c in ("r_score", "f_score", "m_score")]
        )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_id",
        "r_score",
        "f_score",
        "m_score",
        F.concat(*[c.cast("string") for c in (r, f, m)]).alias("rfm_segment_score"),
        segment_label(r, f, m).alias("customer_segment"),
    ).orderBy(F.col("customer_id").asc_nulls_last())


def agg_customer_churn_risk(orders: DataFrame) -> DataFrame:
    """Churn score from recency, frequency and value of orders that were not lost."""
    day, total = day_of("order_purchase_datetime"), F.col("order_total")
    grouped = (
        orders.where(~F.col("order_status").isin(LOST_STATUSES))
        .groupBy("customer_id")
        .agg(
            F.min(day).alias("first_purchase_date"),
            F.max(day).alias("last_purchase_date"),
            F.count_distinct("order_id").alias("total_purchase_count"),
            _avg(F.sum(total), F.count(total)).alias("avg_order_value"),
            money(F.sum(total)).alias("total_lifetime_value"),
        )
        .withColumn(
            "days_since_last_purchase",
            F.datediff(last_order_day(orders), "last_purchase_date"),
        )
    )
    since, count = F.col("days_since_last_purchase"), F.col("total_purchase_count")
    recency = ladder(since, [(30, 5), (60, 15), (90, 25), (180, 35)], 40, op="<=")
    frequency = ladder(count, [(10, 2), (5, 8), (3, 15), (1, 25)], 30)
    value = ladder("total_lifetime_value", [(1000, 2), (500, 8), (200, 15), (100, 23)], 30)
    span = F.datediff("last_purchase_date", "first_purchase_date")
    # Whole-day interval: the day count is divided as an integer.
    interval = F.when(
        count > 1, F.floor(span / F.nullif(count - 1, F.lit(0)).cast("decimal(18,0)")).cast("int")
    )
    scored = grouped.withColumn("churn_risk_score", recency + frequency + value).withColumn(
        "_interval", interval
    )
    score = F.col("churn_risk_score")
    return scored.select(
        "customer_id",
        "first_purchase_date",
        "last_purchase_date",
        "days_since_last_purchase",
        money("_interval").alias("avg_days_between_purchases"),
        F.date_add("last_purchase_date", F.col("_interval")).alias("expected_next_purchase_date"),
        "total_purchase_count",
        "avg_order_value",
        "total_lifetime_value",
        "churn_risk_score",
        money(score).alias("churn_probability_pct"),
        ladder(score, [(75, "very_high"), (60, "high"), (40, "medium")], "low").alias(
            "churn_risk_tier"
        ),
        F.greatest(180 - since, F.lit(0)).alias("days_until_churn_threshold"),
    )


def agg_customer_repurchase_metrics(orders: DataFrame) -> DataFrame:
    """Repeat purchase behaviour over orders that were not lost."""
    day, total = day_of("order_purchase_datetime"), F.col("order_total")
    grouped = (
        orders.where(~F.col("order_status").isin(LOST_STATUSES))
        .groupBy("customer_id")
        .agg(
            F.count_distinct("order_id").alias("total_purchases"),
            F.datediff(F.max(day), F.min(day)).alias("_span"),
            F.max(day).alias("last_purchase_date"),
            money(F.sum(total)).alias("repeat_customer_lifetime_value"),
            _avg(F.sum(total), F.count(total)).alias("avg_repeat_order_value"),
        )
    )
    count = F.col("total_purchases")
    repeat, interval = count > 1, quotient(F.col("_span"), count - 1)
    return grouped.select(
        "customer_id",
        "total_purchases",
        F.when(repeat, 1).otherwise(0).alias("is_repeat_customer"),
        F.when(repeat, _percent(count - 1, count))
        .otherwise(money(F.lit(0)))
        .alias("repeat_purchase_rate"),
        money(r2(interval)).alias("avg_days_between_purchases"),
        # Half of the average interval stands in for the first one.
        F.ceil(interval / 2).cast("int").alias("first_repeat_purchase_days"),
        "repeat_customer_lifetime_value",
        "avg_repeat_order_value",
        "last_purchase_date",
        ladder(
            count, [(10, "high_frequency"), (5, "medium_frequency"), (3, "occasional")], "one_time"
        ).alias("purchase_count_tier"),
        money(ladder(count, [(10, 95), (5, 80), (3, 60), (2, 30)], 10)).alias(
            "repurchase_probability_pct"
        ),
    )


def agg_seller_performance(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Sales per seller. Every line adds the total of its whole order, as defined."""
    context = orders.select(
        "order_id",
        "order_status",
        "order_total",
        "payment_total",
        day_of("order_purchase_datetime").alias("sale_date"),
    )
    status, score, n = F.col("order_status"), F.col("review_score"), F.col("n")
    reduced = lines.groupBy("seller_id", "order_id").agg(
        F.count("*").alias("n"), F.sum(score).alias("score"), F.count(score).alias("scored")
    )
    paid = F.col("payment_total") * n
    per_order = (
        reduced.join(context, "order_id")
        .groupBy("seller_id", "order_id")
        .agg(
            F.min("sale_date").alias("first_sale"),
            F.max("sale_date").alias("last_sale"),
            F.sum(F.col("order_total") * n).alias("total"),
            _lines(F.col("order_total").isNotNull()).alias("valued"),
            _lines(status == "Canceled").alias("canceled"),
            _lines(status == "Unavailable").alias("unavailable"),
            sum_when(status == "Canceled", paid).alias("lost_canceled"),
            sum_when(status == "Unavailable", paid).alias("lost_unavailable"),
            F.sum("score").alias("score"),
            F.sum("scored").alias("scored"),
        )
    )
    grouped = per_order.groupBy("seller_id").agg(
        F.min("first_sale").alias("first_sale_date"),
        F.max("last_sale").alias("last_sale_date"),
        F.sum("total").alias("_total"),
        F.sum("valued").alias("_valued"),
        F.count("order_id").alias("total_order_count"),
        F.sum("canceled").alias("canceled_order_count"),
        F.sum("unavailable").alias("unavailable_order_count"),
        F.sum("lost_canceled").alias("_lost_canceled"),
        F.sum("lost_unavailable").alias("_lost_unavailable"),
        _avg(F.sum("score"), F.sum("scored")).alias("avg_review_score"),
    )
    today = last_order_day(orders)
    since = F.datediff(today, "last_sale_date")
    tenure = F.datediff(today, "first_sale_date")
    count = F.col("total_order_count")
    problems = F.col("canceled_order_count") + F.col("unavailable_order_count")
    return grouped.select(
        "seller_id",
        "first_sale_date",
        "last_sale_date",
        since.alias("days_since_last_sale"),
        money("_total").alias("life_time_seller_sales_value"),
        _avg(F.col("_total"), F.col("_valued")).alias("avg_sale_value"),
        "total_order_count",
        "canceled_order_count",
        "unavailable_order_count",
        money("_lost_canceled").alias("lost_revenue_canceled"),
        money("_lost_unavailable").alias("lost_revenue_unavailable"),
        "avg_review_score",
        # Divided by 30 here, multiplied for customers; both as defined.
        money(r2(quotient(count, tenure) / 30)).alias("avg_monthly_orders"),
        money(r2(quotient(F.col("_total"), tenure) / 30)).alias("avg_monthly_revenue"),
        _percent(problems, count).alias("order_problem_rate"),
        recency_status(since).alias("seller_status"),
    )


def agg_seller_health_scorecard(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivery, satisfaction and fulfilment scores per seller.

    A line without a delivery date counts as late here, unlike in the order fact.
    """
    delivered = F.col("order_delivered_customer_datetime")
    context = orders.select(
        "order_id",
        "order_status",
        "payment_total",
        day_of("order_purchase_datetime").alias("sale_date"),
        (delivered <= F.col("order_estimated_delivery_datetime")).alias("on_time"),
        seconds_between(delivered, "order_purchase_datetime").alias("seconds"),
    )
    status, score, n = F.col("order_status"), F.col("review_score"), F.col("n")
    reduced = lines.groupBy("seller_id", "order_id").agg(
        F.count("*").alias("n"),
        F.sum("item_price").alias("price"),
        F.sum(score).alias("score"),
        F.count(score).alias("scored"),
        F.max(score).alias("best"),
    )
    per_order = (
        reduced.join(context, "order_id", "left")
        .groupBy("seller_id", "order_id")
        .agg(
            F.sum(n).alias("n"),
            _lines(~status.isin(LOST_STATUSES)).alias("completed"),
            _lines(status == "Canceled").alias("canceled"),
            F.sum("price").alias("price"),
            F.sum(F.col("payment_total") * n).alias("paid"),
            _lines(F.col("payment_total").isNotNull()).alias("paid_lines"),
            _lines(F.col("on_time")).alias("on_time"),
            F.sum(F.col("seconds") * n).alias("seconds"),
            _lines(F.col("seconds").isNotNull()).alias("timed_lines"),
            F.sum("score").alias("score"),
            F.sum("scored").alias("scored"),
            F.max("best").alias("best"),
            F.min("sale_date").alias("first_sale"),
            F.max("sale_date").alias("last_sale"),
        )
    )
    sellers = per_order.groupBy("seller_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("completed").alias("completed_orders"),
        F.sum("canceled").alias("canceled_orders"),
        money(F.sum("price")).alias("total_revenue"),
        _avg(F.sum("paid"), F.sum("paid_lines")).alias("avg_order_value"),
        _percent(F.sum("on_time"), F.sum("n")).alias("on_time_delivery_rate"),
        _avg(F.sum("seconds"), F.sum("timed_lines") * 3600).alias("avg_fulfillment_time_hours"),
        _avg(F.sum("score"), F.sum("scored")).alias("avg_review_score"),
        _percent(count_when(F.col("best") >= 4), count_when(F.col("scored") > 0)).alias(
            "satisfaction_rate"
        ),
        F.min("first_sale").alias("first_sale_date"),
        F.max("last_sale").alias("last_sale_date"),
    )
    products = (
        lines.select(F.col("seller_id").alias("_seller"), "product_id")
        .distinct()
        .groupBy("_seller")
        .agg(F.count("product_id").alias("unique_products_sold"))
    )
    rate, score = F.col("on_time_delivery_rate"), F.col("avg_review_score")
    fulfilled = quotient("completed_orders", "total_orders")
    scored = sellers.join(products, F.col("seller_id").eqNullSafe(F.col("_seller")), "left").select(
        "seller_id",
        "total_orders",
        "unique_products_sold",
        *sellers.columns[2:],
        F.datediff(last_order_day(orders), "first_sale_date").alias("seller_tenure_days"),
        ladder(
            rate, [(95, 40), (90, 35), (85, 30), (80, 25), (75, 20), (70, 15), (60, 10)], 5
        ).alias("delivery_quality_score"),
        ladder(
            score.cast("decimal(18,2)"),
            [
                (_dec("4.7"), 35),
                (_dec("4.5"), 32),
                (_dec("4.3"), 28),
                (_dec("4.0"), 24),
                (_dec("3.7"), 18),
                (_dec("3.5"), 12),
            ],
            5,
        ).alias("customer_satisfaction_score"),
        ladder(
            fulfilled,
            [
                (_dec("0.95"), 25),
                (_dec("0.90"), 22),
                (_dec("0.85"), 18),
                (_dec("0.80"), 14),
                (_dec("0.70"), 10),
            ],
            5,
        ).alias("fulfillment_score"),
    )
    performance = (
        F.col("delivery_quality_score")
        + F.col("customer_satisfaction_score")
        + F.col("fulfillment_score")
    )
    return scored.select(
        "*",
        performance.alias("performance_score"),
        ladder(performance, [(85, "low"), (65, "medium")], "high").alias("risk_tier"),
        F.when(rate < 95, F.ceil((95 - rate) / 5).cast("int"))
        .otherwise(0)
        .alias("days_to_improvement_target"),
        F.when(performance >= 85, "maintain")
        .when(performance >= 65, "monitor")
        .when(rate < 85, "improve_delivery")
        .when(score < _dec("3.5"), "improve_quality")
        .otherwise("investigate")
        .alias("recommended_action"),
    )


def _dec(text: str) -> Column:
    return F.lit(text).cast("decimal(6,2)")


def agg_product_quality_metrics(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Ratings, returns and defect risk per product."""
    context = orders.select(
        "order_id", (F.col("order_status") == "Canceled").alias("is_canceled")
    )
    score = F.col("review_score")
    stars = [5, 4, 3, 2, 1]
    reduced = lines.groupBy("product_id", "order_id").agg(
        F.sum(score).alias("score"),
        F.count(score).alias("scored"),
        *[count_when(score == s).alias(f"star_{s}") for s in stars],
        count_when(score >= 4).alias("satisfied"),
    )
    totals = [c for c in reduced.columns if c not in ("product_id", "order_id")]
    per_order = (
        reduced.join(context, "order_id", "left")
        .groupBy("product_id", "order_id")
        .agg(
            F.max("is_canceled").alias("is_canceled"), *[F.sum(c).alias(c) for c in totals]
        )
    )
    reviewed, returned = count_when(F.col("scored") > 0), count_when(F.col("is_canceled"))
    products = per_order.groupBy("product_id").agg(
        reviewed.alias("total_reviews"),
        _avg(F.sum("score"), F.sum("scored")).alias("avg_rating"),
        *[F.sum(f"star_{s}").alias(f"reviews_{s}_star") for s in stars],
        returned.alias("return_count"),
        _percent(returned, F.count("order_id")).alias("return_rate"),
        _percent(F.sum("satisfied"), reviewed).alias("satisfaction_rate"),
        F.count("order_id").alias("total_orders"),
    )
    rating, satisfaction = F.col("avg_rating"), F.col("satisfaction_rate")
    tier = F.lit(1)
    for low_rating, low_satisfaction, value in (
        ("3.0", 60, 2),
        ("3.5", 70, 3),
        ("4.0", 80, 4),
        ("4.5", 90, 5),
    ):
        tier = F.when(
            (rating >= _dec(low_rating)) & (satisfaction >= low_satisfaction), value
        ).otherwise(tier)
    returns = ladder("return_rate", [(5, 5), (10, 15), (15, 30), (20, 40)], 50, op="<=")
    ratings = ladder(
        rating, [(_dec("4.5"), 0), (_dec("4.0"), 10), (_dec("3.5"), 20), (_dec("3.0"), 35)], 50
    )
    return products.select(
        "*", tier.alias("quality_tier"), (returns + ratings).alias("defect_risk_score")
    )


def agg_marketing_channel_performance(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Leads, conversions and a quality score per marketing channel."""
    by_lead = leads.groupBy(F.col("mql_origin_category").alias("channel")).agg(
        F.count_distinct("mql_id").alias("leads")
    )
    revenue, days = F.col("lead_business_monthly_revenue"), F.col("days_to_close")
    by_deal = (
        deals.where(
            (F.col("mql_link_status") == "linked") & F.col("mql_origin_category").isNotNull()
        )
        .groupBy(F.col("mql_origin_category").alias("channel"))
        .agg(
            F.count_distinct("mql_id").alias("deals"),
            F.count_distinct("seller_id").alias("unique_sellers"),
            money(F.sum(revenue)).alias("declared"),
            _avg(F.sum(revenue), F.count(revenue)).alias("avg_deal_value"),
            _avg(F.sum(days), F.count(days)).alias("avg_days_to_close"),
        )
    )

    def or_zero(column: str) -> Column:
        return F.coalesce(column, F.lit(0))

    mql_count, deal_count = or_zero("leads"), or_zero("deals")
    conversion = quotient(deal_count, mql_count) * 100
    return (
        by_lead.join(by_deal, "channel", "full")
        .where(F.col("channel").isNotNull())
        .select(
            "channel",
            mql_count.alias("mql_count"),
            deal_count.alias("deals_closed"),
            F.when(mql_count > 0, money(r2(conversion)))
            .otherwise(money(F.lit(0)))
            .alias("mql_to_deal_conversion_rate"),
            "avg_days_to_close",
            "avg_deal_value",
            "unique_sellers",
            money(r2(quotient(or_zero("declared"), mql_count))).alias(
                "seller_ltv_vs_declared_revenue"
            ),
            money(r2(quotient(deal_count * or_zero("avg_deal_value"), mql_count))).alias(
                "channel_roi"
            ),
            (
                ladder(conversion, [(15, 40), (10, 30), (5, 20)], 10)
                + ladder(or_zero("avg_days_to_close"), [(30, 35), (60, 25), (90, 15)], 5, op="<=")
                + ladder(or_zero("avg_deal_value"), [(10000, 25), (5000, 18), (1000, 10)], 5)
            ).alias("quality_score"),
        )
    )


def mql_details_wide(deals: DataFrame, sellers: DataFrame) -> DataFrame:
    """Closed deals next to what the seller went on to sell, latest contact first."""
    performance = sellers.select(
        "seller_id",
        "first_sale_date",
        "last_sale_date",
        "days_since_last_sale",
        "life_time_seller_sales_value",
        "avg_sale_value",
        "lost_revenue_canceled",
        "lost_revenue_unavailable",
        "avg_review_score",
        "seller_status",
        "avg_monthly_orders",
        "avg_monthly_revenue",
        "order_problem_rate",
    )
    ratio = money(r2(quotient("life_time_seller_sales_value", "declared_monthly_revenue")))
    return (
        deals.withColumnsRenamed(
            {
                "lead_business_monthly_revenue": "declared_monthly_revenue",
                "lead_business_product_catalog_size": "declared_catalog_size",
                "lead_business_average_stock": "declared_avg_stock",
            }
        )
        .join(performance, "seller_id", "left")
        .withColumn("actual_vs_declared_revenue_ratio", ratio)
        .select(
            "mql_id",
            "seller_id",
            "mql_first_contact_date",
            "deal_closed_datetime",
            "days_to_close",
            "mql_origin_category",
            "lead_business_segment",
            "lead_business_category",
            "lead_behaviour_profile_category",
            "declared_monthly_revenue",
            "declared_catalog_size",
            "declared_avg_stock",
            "has_company",
            "has_gtin",
            "first_sale_date",
            "last_sale_date",
            "days_since_last_sale",
            "life_time_seller_sales_value",
            "avg_sale_value",
            "lost_revenue_canceled",
            "lost_revenue_unavailable",
            "avg_review_score",
            "seller_status",
            "actual_vs_declared_revenue_ratio",
            F.datediff("first_sale_date", day_of("deal_closed_datetime")).alias(
                "days_to_first_sale"
            ),
            "avg_monthly_orders",
            "avg_monthly_revenue",
            "order_problem_rate",
            # No ratio counts as the lowest category.
            ladder(
                "actual_vs_declared_revenue_ratio",
                [
                    (_dec("1.2"), "Exceptional Performance"),
                    (_dec("1.0"), "Above Expectations"),
                    (_dec("0.8"), "Meeting Expectations"),
                    (_dec("0.5"), "Underperforming"),
                ],
                "Severely Underperforming",
            ).alias("revenue_performance_category"),
        )
        # The lead id only splits days with very many deals.
        .orderBy(F.col("mql_first_contact_date").desc_nulls_first(), "mql_id")
    )
