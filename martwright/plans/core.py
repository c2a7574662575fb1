"""Dimensions, facts, bridge and the daily aggregate.

Side tables are never hinted: Spark broadcasts them when their measured size allows and
otherwise falls back to a sort-merge join whose skewed partitions are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions import (
    count_when,
    day_of,
    hours_between,
    money,
    quotient,
    r2,
    sum_when,
    whole_days_between,
)
from martwright.operators.ordering import running_total

LOST_STATUSES = ["Canceled", "Unavailable"]

# States of each region, first match wins (SP and MG are claimed twice).
REGIONS = {
    "Southeast": ["RJ", "SP", "ES", "MG"],
    "South": ["PR", "SC", "RS"],
    "Central-West": ["SP", "MG", "GO", "DF"],
    "North": ["AM", "RR", "AP", "PA", "TO", "AC"],
    "Northeast": ["CE", "RN", "PE", "AL", "SE", "BA", "PI", "MA"],
}

# Lower-case city spellings of each metropolitan area.
METRO_AREAS = {
    "São Paulo Metro": ["são paulo", "sp"],
    "Rio de Janeiro Metro": ["rio de janeiro", "rj"],
    "Belo Horizonte Metro": ["belo horizonte", "mg"],
    "Brasília": ["brasília", "df"],
    "Salvador Metro": ["salvador", "ba"],
    "Fortaleza Metro": ["fortaleza", "ce"],
    "Recife Metro": ["recife", "pe"],
    "Porto Alegre Metro": ["porto alegre", "rs"],
    "Curitiba Metro": ["curitiba", "pr"],
    "Manaus Metro": ["manaus", "am"],
}


def _first_list_with(value: Column, lists: dict[str, list[str]], otherwise: str) -> Column:
    chain = None
    for label, members in lists.items():
        hit = value.isin(members)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(otherwise)


def _as_of(as_of: str | None) -> Column:
    return F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def _with_geography(df: DataFrame, prefix: str, geolocation: DataFrame) -> DataFrame:
    """City and state of the zip where known, the row's own otherwise."""
    geo = geolocation.select(
        F.col("zip_code").alias(f"{prefix}_zip_code"),
        F.col("city").alias("_city"),
        F.col("state").alias("_state"),
    )
    return (
        df.join(geo, f"{prefix}_zip_code", "left")
        .withColumn(f"{prefix}_city", F.coalesce("_city", f"{prefix}_city"))
        .withColumn(f"{prefix}_state", F.coalesce("_state", f"{prefix}_state"))
        .select(*df.columns)
    )


def dim_customers(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """One row per person, order and geography; several places of a zip repeat the customer.

    As equal rows count once in the end, equal places are taken once before the join.
    """
    places = geolocation.select("zip_code", "city", "state").distinct()
    return _with_geography(customers, "customer", places).distinct()


def dim_sellers(sellers: DataFrame, geolocation: DataFrame) -> DataFrame:
    return _with_geography(sellers, "seller", geolocation)


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    english = translation.select(
        F.col("product_category_name").alias("product_category"),
        F.col("product_category_name_english").alias("_english"),
    )
    return products.join(english, "product_category", "left").select(
        "product_id",
        F.col("_english").alias("product_category"),
        *[c for c in products.columns if c not in ("product_id", "product_category")],
    )


def dim_location(geolocation: DataFrame, as_of: str | None = None) -> DataFrame:
    """Zip hierarchy. The id numbers the zips of a state by city, then zip."""
    zips = geolocation.select("zip_code", "city", "state").distinct()
    numbered = running_total(zips, ["state"], [F.col("city"), F.col("zip_code")], "_number")
    return numbered.select(
        "zip_code",
        "city",
        "state",
        _first_list_with(F.col("state"), REGIONS, "Unknown").alias("region"),
        _first_list_with(F.lower("city"), METRO_AREAS, "Non-Metro").alias("metro_area"),
        F.concat(F.coalesce("state", F.lit("")), F.lit("_"), F.col("_number").cast("string")).alias(
            "geographic_region_id"
        ),
        _as_of(as_of).alias("created_at"),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def dim_date(orders: DataFrame) -> DataFrame:
    """Calendar from the first order day to one year after the last, one row per day."""
    bounds = orders.agg(
        F.min(day_of("order_purchase_datetime")).alias("first_day"),
        F.add_months(F.max(day_of("order_purchase_datetime")), 12).alias("end_day"),
    )
    days = bounds.select(F.explode(F.sequence("first_day", "end_day")).alias("calendar_date"))
    d = F.col("calendar_date")
    iso_day = F.weekday(d) + 1
    iso_year, iso_week = F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)
    month, day = F.month(d), F.dayofmonth(d)
    weekend = iso_day >= 6
    return days.select(
        d,
        F.year(d).alias("calendar_year"),
        month.alias("calendar_month"),
        F.quarter(d).alias("calendar_quarter"),
        day.alias("day_of_month"),
        (F.dayofweek(d) - 1).alias("day_of_week_numeric"),
        iso_day.alias("iso_day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        iso_week.alias("week_of_year"),
        iso_year.alias("iso_year"),
        F.concat(
            iso_year.cast("string"), F.lit("-W"), F.lpad(iso_week.cast("string"), 2, "0")
        ).alias("iso_week_number"),
        # Full names are blank-padded to nine characters, as to_char does.
        F.rpad(F.date_format(d, "EEEE"), 9, " ").alias("day_name"),
        F.date_format(d, "EEE").alias("day_abbreviation"),
        F.rpad(F.date_format(d, "MMMM"), 9, " ").alias("month_name"),
        F.date_format(d, "MMM").alias("month_abbreviation"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"),
        month.alias("fiscal_month"),
        _flag(weekend).alias("is_weekend_flag"),
        _flag(~weekend).alias("is_weekday_flag"),
        _flag(~weekend).alias("is_business_day_flag"),
        _flag(day == 1).alias("is_first_day_of_month_flag"),
        _flag(d == F.last_day(d)).alias("is_last_day_of_month_flag"),
        _flag(iso_day == 1).alias("is_monday_flag"),
        _flag(iso_day == 5).alias("is_friday_flag"),
        _flag(iso_day == 1).alias("is_week_start_flag"),
        _flag(iso_day == 7).alias("is_week_end_flag"),
        _flag(d == F.trunc(d, "quarter")).alias("is_quarter_start_flag"),
        _flag(F.dayofyear(d) == 1).alias("is_year_start_flag"),
        _flag((month == 12) & (day == 31)).alias("is_year_end_flag"),
        F.unix_date(d).alias("days_since_epoch"),
    ).orderBy("calendar_date")


def fact_orders(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    customers: DataFrame,
) -> DataFrame:
    """One row per order with line, payment and review totals.

    The customer lookup by per-order id comes first, while the rows are narrow. The three
    detail tables are reduced to order grain before they are joined; they share the order id
    partitioning, and so does the result.
    """
    price, freight = F.sum("item_price"), F.sum("item_freight_value")
    per_items = items.groupBy("order_id").agg(
        F.count("order_item_id").alias("order_item_count"),
        money(price).alias("order_item_price_total"),
        money(freight).alias("order_freight_total"),
        money(price + freight).alias("order_total"),
    )
    per_payments = payments.groupBy("order_id").agg(
        F.count_distinct("payment_type_sequence").alias("payment_count"),
        F.count_distinct("payment_type").alias("payment_method_type_count"),
        F.max("payment_installment_count").alias("payment_installment_count"),
        money(F.sum("payment_value")).alias("payment_total"),
    )
    per_reviews = reviews.groupBy("order_id").agg(
        F.count("*").alias("review_count"),
        money(r2(quotient(F.sum("review_score"), F.count("review_score")))).alias(
            "avg_review_score"
        ),
        F.max("review_score").alias("max_review_score"),
        F.min("review_score").alias("min_review_score"),
    )
    people = customers.select("order_customer_id", "customer_id")
    purchase = F.col("order_purchase_datetime")
    delivered = F.col("order_delivered_customer_datetime")
    estimated = F.col("order_estimated_delivery_datetime")

    def or_zero(column: str) -> Column:
        return F.coalesce(column, F.lit(0)).alias(column)

    def money_or_zero(column: str) -> Column:
        return F.coalesce(column, money(F.lit(0))).alias(column)

    return (
        orders.join(people, "order_customer_id", "left")
        .join(per_items, "order_id", "left")
        .join(per_payments, "order_id", "left")
        .join(per_reviews, "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "order_status",
            or_zero("order_item_count"),
            money_or_zero("order_item_price_total"),
            money_or_zero("order_freight_total"),
            money_or_zero("order_total"),
            or_zero("payment_count"),
            or_zero("payment_method_type_count"),
            or_zero("payment_installment_count"),
            money_or_zero("payment_total"),
            or_zero("review_count"),
            "avg_review_score",
            "max_review_score",
            "min_review_score",
            # Not delivered: unknown. Delivered without an estimate: late.
            F.when(delivered <= estimated, 1)
            .when(delivered.isNotNull(), 0)
            .alias("on_time_delivery_flag"),
            hours_between("order_approved_datetime", purchase).alias("time_to_approval_hours"),
            hours_between("order_delivered_carrier_datetime", purchase).alias(
                "time_to_ship_hours"
            ),
            hours_between(delivered, purchase).alias("time_to_deliver_hours"),
            hours_between(delivered, estimated).alias("delivery_estimation_slip_hours"),
            "order_purchase_datetime",
            "order_approved_datetime",
            "order_delivered_carrier_datetime",
            "order_delivered_customer_datetime",
            "order_estimated_delivery_datetime",
        )
    )


def fact_order_lines(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Order lines with order status and review score; a second review repeats the lines.

    Reviews count only where the order is known. They are matched on the line's own order
    id all the same, so that both joins share one partitioning and either can be split at
    run time when an order has very many lines.
    """
    context = orders.select(
        "order_id", "order_customer_id", "order_status", F.lit(True).alias("_known")
    )
    scores = reviews.select(F.col("order_id").alias("_reviewed"), "review_score")
    return (
        items.join(context, "order_id", "left")
        .join(scores, (F.col("order_id") == F.col("_reviewed")) & F.col("_known"), "left")
        .select(
            "order_id",
            "order_item_id",
            "order_customer_id",
            "order_status",
            "product_id",
            "seller_id",
            "shipping_limit_datetime",
            "item_price",
            "item_freight_value",
            "review_score",
        )
    )


def fact_payments(payments: DataFrame, orders: DataFrame, as_of: str | None = None) -> DataFrame:
    context = orders.select(
        "order_id", "order_status", F.col("order_purchase_datetime").alias("payment_date")
    )
    sequence = F.coalesce(F.col("payment_type_sequence").cast("string"), F.lit(""))
    return payments.join(context, "order_id", "left").select(
        "order_id",
        F.concat(F.col("order_id").cast("string"), F.lit("_"), sequence).alias("payment_id"),
        "payment_type_sequence",
        "payment_type",
        "payment_value",
        "payment_installment_count",
        "payment_date",
        _flag(F.col("order_status").isin(LOST_STATUSES)).alias("is_refunded"),
        _as_of(as_of).alias("created_at"),
    )


def fact_reviews(reviews: DataFrame, orders: DataFrame, as_of: str | None = None) -> DataFrame:
    """Reviews with their order; ``customer_id`` is the per-order id here."""
    context = orders.select(
        "order_id", F.col("order_customer_id").alias("customer_id"), "order_purchase_datetime"
    )
    message = F.col("review_comment_message")
    return reviews.join(context, "order_id", "left").select(
        "review_id",
        "order_id",
        "customer_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        F.coalesce(F.length(message), F.lit(0)).alias("review_comment_length"),
        _flag(message.isNotNull()).alias("has_comment_flag"),
        F.col("review_creation_datetime").alias("review_date"),
        "review_answer_datetime",
        "order_purchase_datetime",
        whole_days_between("review_creation_datetime", "order_purchase_datetime").alias(
            "days_to_review"
        ),
        _as_of(as_of).alias("created_at"),
    )


def fact_closed_deals(deals: DataFrame, leads: DataFrame) -> DataFrame:
    origin = leads.select("*", F.lit("linked").alias("_link"))
    return deals.join(origin, "mql_id", "left").select(
        "mql_id",
        "seller_id",
        "sdr_id",
        "sr_id",
        F.coalesce("_link", F.lit("orphaned")).alias("mql_link_status"),
        "mql_first_contact_date",
        "deal_closed_datetime",
        whole_days_between("deal_closed_datetime", "mql_first_contact_date").alias(
            "days_to_close"
        ),
        "mql_landing_page_id",
        "mql_origin_category",
        "lead_business_segment",
        "lead_business_category",
        "lead_behaviour_profile_category",
        "has_company",
        "has_gtin",
        "lead_business_average_stock",
        "lead_business_product_catalog_size",
        "lead_business_monthly_revenue",
    )


def fact_product_daily_metrics(
    lines: DataFrame, orders: DataFrame, as_of: str | None = None
) -> DataFrame:
    """Sales of a product per purchase day, without canceled and unavailable orders.

    ``units_refunded`` is always 0 because the filter has already removed what it counts.
    Lines are reduced per order before and after they meet it, which takes no further shuffle.
    The first row of an order there stands for the order, so orders are counted without a
    distinct count.
    """
    context = orders.where(~F.col("order_status").isin(LOST_STATUSES)).select(
        "order_id",
        "customer_id",
        F.col("order_status").alias("_status"),
        day_of("order_purchase_datetime").alias("order_date"),
    )
    price, score = F.col("item_price"), F.col("review_score")
    reduced = lines.groupBy("product_id", "order_id", "seller_id").agg(
        F.count("*").alias("n"),
        F.sum(price).alias("price"),
        F.count(price).alias("priced"),
        F.min(price).alias("lowest"),
        F.max(price).alias("highest"),
        F.sum("item_freight_value").alias("freight"),
        F.sum(score).alias("score"),
        F.count(score).alias("scored"),
    )
    totals = ["price", "priced", "freight", "score", "scored"]
    per_order = (
        reduced.join(context, "order_id")
        .groupBy("product_id", "order_date", "order_id", "customer_id", "seller_id")
        .agg(
            F.sum(F.when(F.col("_status") == "Canceled", F.col("n")).otherwise(0)).alias(
                "refunded"
            ),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            *[F.sum(c).alias(c) for c in totals],
        )
    )
    same_order = Window.partitionBy("order_id", "product_id", "order_date").orderBy(
        "customer_id", "seller_id"
    )
    per_order = per_order.withColumn("is_first", F.row_number().over(same_order) == 1)
    # Distinct counts of two columns in one aggregation would write every row three times, and apart
    # they would join everything anew. Dealt out by (product, day) once, the first row of each buyer
    # and of each seller stands for it, and the last aggregation needs no further shuffle.
    dealt = per_order.repartition("product_id", "order_date")
    for column, other in (("customer_id", "seller_id"), ("seller_id", "customer_id")):
        same = Window.partitionBy("product_id", "order_date", column).orderBy("order_id", other)
        first = F.col(column).isNotNull() & (F.row_number().over(same) == 1)
        dealt = dealt.withColumn(f"first_{column}", first)
    total_price, total_freight = F.sum("price"), F.sum("freight")
    measured = dealt.groupBy("product_id", "order_date").agg(
        count_when(F.col("is_first")).alias("units_sold"),
        F.sum("refunded").alias("units_refunded"),
        money(total_price).alias("gross_revenue"),
        money(total_freight).alias("freight_revenue"),
        money(total_price + total_freight).alias("total_revenue"),
        count_when(F.col("first_customer_id")).alias("distinct_buyers"),
        count_when(F.col("first_seller_id")).alias("distinct_sellers"),
        money(r2(quotient(F.sum("score"), F.sum("scored")))).alias("avg_review_score"),
        count_when(F.col("is_first") & (F.col("scored") > 0)).alias("review_count"),
        money(F.min("lowest")).alias("price_min"),
        money(r2(quotient(total_price, F.sum("priced")))).alias("price_avg"),
        money(F.max("highest")).alias("price_max"),
        money(r2(quotient(total_freight, total_price) * 100)).alias(
            "freight_cost_pct_of_revenue"
        ),
    )
    return measured.select(
        "product_id",
        "order_date",
        "units_sold",
        "units_refunded",
        "gross_revenue",
        "freight_revenue",
        "total_revenue",
        "distinct_buyers",
        "distinct_sellers",
        "avg_review_score",
        "review_count",
        "price_min",
        "price_avg",
        "price_max",
        "freight_cost_pct_of_revenue",
        _as_of(as_of).alias("created_at"),
    )


def last_order_day(orders: DataFrame) -> Column:
    """The largest order date of all orders: the data's own "today".

    A scalar subquery, computed once and without a cross join; Spark drops the outer
    joins behind ``orders`` from it because a maximum does not depend on them.
    """
    return orders.agg(F.max(day_of("order_purchase_datetime"))).scalar()


def bridge_product_seller(lines: DataFrame, orders: DataFrame) -> DataFrame:
    context = orders.select("order_id", day_of("order_purchase_datetime").alias("sale_date"))
    price, score = F.col("item_price"), F.col("review_score")
    reduced = lines.groupBy("product_id", "seller_id", "order_id").agg(
        F.count("*").alias("line_items"),
        F.sum(price).alias("price"),
        F.count(price).alias("priced"),
        F.sum("item_freight_value").alias("freight"),
        F.sum(score).alias("score"),
        F.count(score).alias("scored"),
    )
    totals = ["line_items", "price", "priced", "freight", "score", "scored"]
    per_order = (
        reduced.join(context, "order_id", "left")
        .groupBy("product_id", "seller_id", "order_id")
        .agg(
            F.min("sale_date").alias("first_sale"),
            F.max("sale_date").alias("last_sale"),
            *[F.sum(c).alias(c) for c in totals],
        )
    )
    price_sum, freight_sum = F.sum("price"), F.sum("freight")
    pairs = per_order.groupBy("product_id", "seller_id").agg(
        F.min("first_sale").alias("first_sale_date"),
        F.max("last_sale").alias("last_sale_date"),
        F.count("order_id").alias("total_orders"),
        F.sum("line_items").alias("total_line_items"),
        money(price_sum).alias("total_revenue"),
        money(freight_sum).alias("total_freight_cost"),
        money(price_sum + freight_sum).alias("total_revenue_with_freight"),
        money(r2(quotient(price_sum, F.sum("priced")))).alias("avg_item_price"),
        money(r2(quotient(F.sum("score"), F.sum("scored")))).alias("avg_review_score"),
    )
    return pairs.select(
        "*",
        F.col("total_orders").alias("order_count"),
        F.datediff(last_order_day(orders), "last_sale_date").alias("days_since_last_sale"),
    )


def agg_daily_sales(orders: DataFrame) -> DataFrame:
    canceled = F.col("order_status") == "Canceled"
    unavailable = F.col("order_status") == "Unavailable"
    score = F.col("avg_review_score")
    return orders.groupBy(day_of("order_purchase_datetime").alias("order_date")).agg(
        F.count("order_id").alias("total_order_count"),
        count_when(canceled).alias("canceled_order_count"),
        count_when(unavailable).alias("unavailable_order_count"),
        money(F.sum("order_total")).alias("total_order_value"),
        money(F.sum("payment_total")).alias("total_paid"),
        money(sum_when(canceled, "payment_total")).alias("lost_revenue_canceled"),
        money(sum_when(unavailable, "payment_total")).alias("lost_revenue_unavailable"),
        money(r2(quotient(F.sum(score), F.count(score)))).alias("avg_review_score"),
    )
