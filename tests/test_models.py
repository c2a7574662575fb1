import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martwright.plans import core, marts, staging
from martwright.plans.catalog import MODELS, Warehouse
from martwright.schemas import RAW_SCHEMAS

DAY = dt.datetime(2018, 1, 1)


def at(days=0, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def raw(spark, name, *rows):
    return spark.createDataFrame(list(rows), RAW_SCHEMAS[name])


def money(text):
    return Decimal(text)


@pytest.fixture(scope="module")
def small(spark):
    """Four orders of two people; o2 has two reviews, o3 no customer, o4 nothing at all."""
    tables = {
        "raw_orders": raw(
            spark,
            "raw_orders",
            ("o1", "c1", "delivered", at(0, 6), at(0, 7), at(1), at(4), at(10)),
            ("o2", "c2", "delivered", at(30), None, at(32), at(45), at(40)),
            ("o3", "c3", "canceled", at(60), None, None, None, None),
            ("o4", "c4", "delivered", at(90), None, None, at(95), None),
            (None, "c5", "shipped", at(0), None, None, None, None),
        ),
        "raw_order_items": raw(
            spark,
            "raw_order_items",
            ("o1", 1, "p1", "s1", at(3), money("10.00"), money("1.00")),
            ("o1", 2, "p2", "s1", at(3), money("20.00"), money("2.00")),
            ("o2", 1, "p1", "s2", at(33), money("40.00"), money("4.00")),
            ("o3", 1, "p1", None, at(63), money("5.00"), money("0.50")),
            ("ox", 1, "p1", "s1", at(63), money("7.00"), money("0.70")),
            ("o4", 1, None, "s1", at(63), money("9.00"), money("0.90")),
        ),
        "raw_order_payments": raw(
            spark,
            "raw_order_payments",
            ("o1", 1, "credit_card", 3, money("30.00")),
            ("o1", 2, "voucher", 0, money("3.00")),
            ("o3", 1, "boleto", 1, money("5.50")),
        ),
        "raw_order_reviews": raw(
            spark,
            "raw_order_reviews",
            ("r1", "o1", 5, None, "ótimo", at(5), at(6)),
            ("r2", "o2", 4, None, None, at(46), at(47)),
            ("r3", "o2", 1, None, None, at(50), at(51)),
            ("r4", "ox", 3, None, None, at(29, 23), at(60)),
        ),
        "raw_customers": raw(
            spark,
            "raw_customers",
            ("c1", "u1", 100, "rio", "rj"),
            ("c2", "u1", 200, "sao-paulo", "sp"),
            ("c4", "u2", None, "x", "mg"),
        ),
        "raw_geolocation": raw(
            spark, "raw_geolocation", (100, "niterói", "rj"), (None, "no zip", "sp")
        ),
    }
    return Warehouse(lambda name: tables[name], as_of="2018-12-31 00:00:00")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_catalog_covers_all_models():
    assert len(MODELS) == 34
    assert sum(m.layer == "staging" for m in MODELS.values()) == 11
    assert sum(m.layer == "intermediate" for m in MODELS.values()) == 13


def test_staging_drops_rows_without_key(small):
    assert small.get("stg_orders").count() == 4
    assert small.get("stg_order_items").count() == 5
    assert small.get("stg_geolocation").count() == 1
    payments = by(small.get("stg_order_payments").where("order_id = 'o1'"), "payment_type_sequence")
    assert (payments[2].payment_type, payments[2].payment_installment_count) == ("Voucher", 1)
    assert payments[1].payment_type == "Credit Card"


def test_dim_customers_takes_city_of_zip(small):
    people = by(small.get("dim_customers"), "order_customer_id")
    assert (people["c1"].customer_city, people["c1"].customer_state) == ("Niterói", "RJ")
    assert (people["c2"].customer_city, people["c2"].customer_state) == ("Sao-Paulo", "SP")
    assert people["c4"].customer_city == "X"


def test_two_geography_rows_repeat_the_customer(spark, small):
    geo = spark.createDataFrame([(100, "A", "RJ"), (100, "B", "RJ")], "zip_code int, city string, state string")
    people = core.dim_customers(small.get("stg_customers"), geo)
    assert people.where("order_customer_id = 'c1'").count() == 2
    orders = core.fact_orders(
        *[small.get(n) for n in ("stg_orders", "stg_order_items", "stg_order_payments", "stg_reviews")],
        people,
    )
    assert orders.where("order_id = 'o1'").count() == 2
    # A repeated order still counts once per seller.
    sellers = by(marts.agg_seller_performance(small.get("fact_order_lines"), orders), "seller_id")
    assert sellers["s1"].total_order_count == 1
    assert sellers["s1"].life_time_seller_sales_value == money("132.00")


def test_fact_orders(small):
    orders = by(small.get("fact_orders"), "order_id")
    o1, o2, o3, o4 = (orders[k] for k in ("o1", "o2", "o3", "o4"))
    assert (o1.customer_id, o1.order_item_count, o1.order_total) == ("u1", 2, money("33.00"))
    assert (o1.payment_count, o1.payment_method_type_count, o1.payment_total) == (2, 2, money("33.00"))
    assert (o1.payment_installment_count, o1.time_to_approval_hours) == (3, 1.0)
    assert (o2.review_count, o2.avg_review_score) == (2, money("2.50"))
    assert (o2.max_review_score, o2.min_review_score, o2.payment_total) == (4, 1, money("0.00"))
    assert o3.customer_id is None and o3.on_time_delivery_flag is None
    assert (o1.on_time_delivery_flag, o2.on_time_delivery_flag) == (1, 0)
    assert o4.on_time_delivery_flag == 0 and o4.order_item_count == 0
    assert o2.delivery_estimation_slip_hours == 120.0 and o4.avg_review_score is None


def test_fact_order_lines_fan_out(small):
    lines = small.get("fact_order_lines")
    assert lines.where("order_id = 'o2'").count() == 2
    orphan = lines.where("order_id = 'ox'").collect()
    # The review of an unknown order is not attached.
    assert len(orphan) == 1 and orphan[0].review_score is None and orphan[0].order_status is None


def test_fact_payments_and_reviews(small):
    payments = by(small.get("fact_payments"), "payment_id")
    assert payments["o3_1"].is_refunded == 1 and payments["o1_2"].is_refunded == 0
    reviews = by(small.get("fact_reviews"), "review_id")
    assert (reviews["r1"].review_comment_length, reviews["r1"].has_comment_flag) == (5, 1)
    assert (reviews["r1"].days_to_review, reviews["r1"].customer_id) == (4, "c1")
    assert reviews["r4"].days_to_review is None and reviews["r4"].has_comment_flag == 0


def test_daily_sales_of_lost_orders(small):
    days = by(small.get("agg_daily_sales"), "order_date")
    lost = days[at(60).date()]
    assert (lost.canceled_order_count, lost.lost_revenue_canceled) == (1, money("5.50"))
    assert lost.lost_revenue_unavailable == money("0.00") and lost.avg_review_score is None


def test_product_daily_metrics_exclude_lost_and_unknown(small):
    rows = small.get("fact_product_daily_metrics").collect()
    assert {(r.product_id, r.order_date) for r in rows} == {
        ("p1", at(0).date()),
        ("p2", at(0).date()),
        ("p1", at(30).date()),
    }
    twice = next(r for r in rows if r.order_date == at(30).date())
    assert (twice.units_sold, twice.gross_revenue, twice.review_count) == (1, money("80.00"), 1)
    assert (twice.avg_review_score, twice.freight_cost_pct_of_revenue) == (money("2.50"), money("10.00"))
    assert twice.units_refunded == 0


def test_bridge_keeps_unknown_orders(small):
    pairs = {(r.product_id, r.seller_id): r for r in small.get("bridge_product_seller").collect()}
    assert pairs[("p1", "s1")].total_orders == 2
    assert pairs[("p1", None)].total_line_items == 1
    assert pairs[("p1", "s2")].days_since_last_sale == 60


def test_customer_performance(small):
    people = by(small.get("agg_customer_performance"), "customer_id")
    u1, nobody = people["u1"], people[None]
    assert (u1.customer_lifetime_days, u1.life_time_customer_value) == (30, money("77.00"))
    assert (u1.days_since_last_purchase, u1.customer_status) == (60, "At Risk")
    assert u1.avg_monthly_spend == money("77.00") and u1.positive_review_rate == money("50.00")
    assert u1.order_value_stddev == money("7.78")
    assert nobody.problem_order_rate == money("100.00")
    assert (people["u2"].order_value_stddev, people["u2"].avg_monthly_orders) == (None, None)
    assert people["u2"].customer_value_tier == "Low Value"


def orders_of(spark, *rows):
    """(customer, order, days, total, status)."""
    return spark.createDataFrame(
        [(c, o, s, money(v), money("0.00"), None, at(d)) for c, o, d, v, s in rows],
        "customer_id string, order_id string, order_status string, order_total decimal(18,2), "
        "payment_total decimal(18,2), avg_review_score decimal(18,2), "
        "order_purchase_datetime timestamp_ntz",
    )


def test_value_tiers_at_their_bounds(spark):
    rows = []
    for name, total in (("a", "1000.00"), ("b", "999.99"), ("c", "500.00"), ("d", "499.99")):
        rows += [(name, name + "1", 0, total, "Delivered"), (name, name + "2", 30, "0.00", "Delivered")]
    tiers = by(marts.agg_customer_performance(orders_of(spark, *rows)), "customer_id")
    assert [tiers[k].customer_value_tier for k in "abcd"] == [
        "High Value",
        "Medium Value",
        "Medium Value",
        "Low Value",
    ]


def test_churn_risk(spark):
    rows = [("a", "a1", 100, "1000.00", "Delivered")]
    rows += [("b", f"b{i}", i * 2, "50.00", "Delivered") for i in range(4)]
    rows += [("c", "c1", 280, "99.99", "Delivered"), ("z", "z1", 285, "1.00", "Canceled")]
    rows += [("n", "n1", 0, "1.00", None)]
    risk = by(marts.agg_customer_churn_risk(orders_of(spark, *rows)), "customer_id")
    # Today is the day of the canceled order, which has no row of its own.
    assert set(risk) == {"a", "b", "c"}
    assert risk["a"].days_since_last_purchase == 185
    assert (risk["a"].churn_risk_score, risk["a"].churn_risk_tier) == (40 + 25 + 2, "high")
    assert risk["b"].churn_risk_score == 40 + 15 + 15 and risk["b"].avg_days_between_purchases == 2
    assert risk["b"].expected_next_purchase_date == at(8).date()
    assert (risk["c"].churn_risk_score, risk["c"].churn_risk_tier) == (5 + 25 + 30, "high")
    assert risk["c"].days_until_churn_threshold == 175
    assert risk["c"].expected_next_purchase_date is None


def test_interval_is_divided_as_an_integer(spark):
    rows = [("a", f"a{i}", d, "10.00", "Delivered") for i, d in enumerate((0, 3, 7))]
    orders = orders_of(spark, *rows)
    risk = marts.agg_customer_churn_risk(orders).first()
    again = marts.agg_customer_repurchase_metrics(orders).first()
    assert risk.avg_days_between_purchases == money("3.00")
    assert risk.expected_next_purchase_date == at(10).date()
    assert again.avg_days_between_purchases == money("3.50")
    assert again.first_repeat_purchase_days == 2


@pytest.mark.parametrize(
    ("count", "tier", "probability"),
    [(1, "one_time", 10), (2, "one_time", 30), (3, "occasional", 60), (5, "medium_frequency", 80), (10, "high_frequency", 95)],
)
def test_repurchase_tiers(spark, count, tier, probability):
    rows = [("a", f"a{i}", i, "10.00", "Delivered") for i in range(count)]
    got = marts.agg_customer_repurchase_metrics(orders_of(spark, *rows)).first()
    assert (got.purchase_count_tier, got.repurchase_probability_pct) == (tier, probability)
    assert got.is_repeat_customer == int(count > 1)


@pytest.mark.parametrize(
    ("scores", "label"),
    [
        ((4, 4, 4), "High-Value Loyal"),
        ((4, 3, 4), "Loyal Customers"),
        ((5, 2, 1), "New Customers"),
        ((1, 5, 4), "At-Risk Loyal"),
        ((2, 1, 2), "Churned / Lost"),
        ((3, 1, 3), "Promising"),
        ((2, 3, 1), "Needs Attention"),
        ((3, 3, 3), "Other"),
    ],
)
def test_segment_labels(spark, scores, label):
    row = spark.range(1).select(marts.segment_label(*map(F.lit, scores)).alias("s")).first()
    assert row.s == label


def test_customer_segments_and_inverted_scores(spark):
    performance = spark.range(10).select(
        F.col("id").alias("customer_id"),
        F.col("id").cast("int").alias("days_since_last_purchase"),
        (100 - F.col("id")).alias("total_order_count"),
        (100 - F.col("id")).cast("decimal(18,2)").alias("life_time_customer_value"),
    )
    plain = by(marts.customer_segments(performance), "customer_id")
    turned = by(marts.customer_segments(performance, invert=True), "customer_id")
    assert plain[0].rfm_segment_score == "111" and plain[9].rfm_segment_score == "555"
    assert plain[0].customer_segment == "Churned / Lost"
    assert turned[0].customer_segment == "High-Value Loyal"


def test_seller_performance_counts_whole_orders_per_line(small):
    sellers = by(small.get("agg_seller_performance"), "seller_id")
    s1 = sellers["s1"]
    assert (s1.total_order_count, s1.life_time_seller_sales_value) == (1, money("66.00"))
    assert s1.avg_monthly_revenue == money("0.02") and s1.seller_status == "At Risk"
    assert sellers["s2"].life_time_seller_sales_value == money("88.00")
    assert sellers[None].order_problem_rate == money("100.00")


def test_seller_scorecard(small):
    cards = by(small.get("agg_seller_health_scorecard"), "seller_id")
    s1 = cards["s1"]
    # Two orders are known by their lines, one of them unknown and so late and not completed.
    assert (s1.total_orders, s1.unique_products_sold, s1.completed_orders) == (2, 2, 2)
    assert s1.on_time_delivery_rate == money("66.67") and s1.delivery_quality_score == 10
    assert s1.avg_fulfillment_time_hours == money("90.00")
    assert (s1.customer_satisfaction_score, s1.fulfillment_score) == (35, 25)
    assert (s1.performance_score, s1.risk_tier, s1.recommended_action) == (70, "medium", "monitor")
    assert s1.days_to_improvement_target == 6
    assert cards["s2"].recommended_action == "improve_delivery"


def lines_of(spark, *rows):
    """(order, product, score)."""
    return spark.createDataFrame(list(rows), "order_id string, product_id string, review_score int")


def test_product_quality_tiers(spark):
    orders = spark.createDataFrame(
        [(f"o{i}", "Canceled" if i == 0 else "Delivered") for i in range(20)],
        "order_id string, order_status string",
    )
    best = lines_of(spark, *[(f"o{i}", "best", 5) for i in range(20)])
    mixed = lines_of(spark, *[(f"o{i}", "mixed", 5 if i % 2 else 3) for i in range(1, 11)])
    silent = lines_of(spark, ("o0", "silent", None))
    got = by(marts.agg_product_quality_metrics(best.union(mixed).union(silent), orders), "product_id")
    assert (got["best"].quality_tier, got["best"].return_rate, got["best"].defect_risk_score) == (5, 5, 5)
    assert (got["mixed"].avg_rating, got["mixed"].satisfaction_rate) == (4, 50)
    assert (got["mixed"].quality_tier, got["mixed"].defect_risk_score) == (1, 15)
    assert (got["silent"].total_reviews, got["silent"].avg_rating) == (0, None)
    assert (got["silent"].defect_risk_score, got["silent"].satisfaction_rate) == (100, None)


def test_marketing_channels(spark):
    leads = spark.createDataFrame([(i, "Social") for i in range(10)] + [(99, None)], "mql_id long, mql_origin_category string")
    deals = spark.createDataFrame(
        [(1, 7, "linked", "Social", money("20000.00"), 10), (2, 7, "linked", "Gone", money("900.00"), 95), (3, 8, "orphaned", None, money("1.00"), None)],
        "mql_id long, seller_id long, mql_link_status string, mql_origin_category string, "
        "lead_business_monthly_revenue decimal(18,2), days_to_close int",
    )
    got = by(marts.agg_marketing_channel_performance(leads, deals), "channel")
    assert set(got) == {"Social", "Gone"}
    assert got["Social"].mql_to_deal_conversion_rate == 10 and got["Social"].quality_score == 30 + 35 + 25
    assert got["Social"].channel_roi == money("2000.00")
    assert (got["Gone"].mql_count, got["Gone"].mql_to_deal_conversion_rate) == (0, 0)
    assert got["Gone"].channel_roi is None and got["Gone"].quality_score == 10 + 5 + 5


def test_channel_without_deals_scores_its_speed(spark):
    leads = spark.createDataFrame([(1, "Email")], "mql_id long, mql_origin_category string")
    none = spark.createDataFrame(
        [],
        "mql_id long, seller_id long, mql_link_status string, mql_origin_category string, "
        "lead_business_monthly_revenue decimal(18,2), days_to_close int",
    )
    got = marts.agg_marketing_channel_performance(leads, none).first()
    assert (got.quality_score, got.avg_deal_value, got.channel_roi) == (10 + 35 + 5, None, 0)


@pytest.mark.parametrize(
    ("value", "label"),
    [
        ("120.00", "Exceptional Performance"),
        ("119.40", "Above Expectations"),
        ("100.00", "Above Expectations"),
        ("99.00", "Meeting Expectations"),
        ("80.00", "Meeting Expectations"),
        ("79.00", "Underperforming"),
        ("50.00", "Underperforming"),
        ("49.00", "Severely Underperforming"),
        (None, "Severely Underperforming"),
    ],
)
def test_deal_categories(spark, value, label):
    deals = core.fact_closed_deals(
        staging.stg_closed_deals(
            raw(
                spark,
                "raw_closed_deals",
                ("m1", "s1", None, None, "2018-01-11", "pet", "offline", None, True, None, None, None, 5.0, money("100.00")),
            )
        ),
        staging.stg_marketing_qualified_leads(
            raw(spark, "raw_marketing_qualified_leads", ("m1", at(0).date(), "l", "paid_search"))
        ),
    )
    sellers = spark.createDataFrame(
        [("s1", at(5).date(), None if value is None else money(value))],
        "seller_id string, first_sale_date date, life_time_seller_sales_value decimal(18,2)",
    )
    for extra in (
        "last_sale_date days_since_last_sale avg_sale_value lost_revenue_canceled "
        "lost_revenue_unavailable avg_review_score seller_status avg_monthly_orders "
        "avg_monthly_revenue order_problem_rate"
    ).split():
        sellers = sellers.withColumn(extra, F.lit(None).cast("int"))
    got = marts.mql_details_wide(deals, sellers).first()
    assert got.revenue_performance_category == label
    assert (got.days_to_close, got.days_to_first_sale, got.mql_origin_category) == (10, -5, "Paid Search")


def test_dim_location(spark):
    geo = spark.createDataFrame(
        [(1, "São Paulo", "SP"), (1, "São Paulo", "SP"), (2, "Campinas", "SP"), (3, "Brasília", "DF"), (4, "Cuiabá", "MT"), (5, "X", None)],
        "zip_code int, city string, state string",
    )
    got = by(core.dim_location(geo, "2018-12-31"), "zip_code")
    assert (got[1].region, got[1].metro_area, got[1].geographic_region_id) == ("Southeast", "São Paulo Metro", "SP_2")
    assert (got[2].metro_area, got[2].geographic_region_id) == ("Non-Metro", "SP_1")
    assert (got[3].region, got[3].metro_area) == ("Central-West", "Brasília")
    assert (got[4].region, got[5].geographic_region_id) == ("Unknown", "_1")


def test_dim_date(spark):
    orders = spark.createDataFrame([(dt.datetime(2019, 12, 30, 23),), (dt.datetime(2020, 2, 29, 1),)], "order_purchase_datetime timestamp_ntz")
    days = by(core.dim_date(orders), "calendar_date")
    # One year after 29 February is the last of February.
    assert min(days) == dt.date(2019, 12, 30) and max(days) == dt.date(2021, 2, 28)
    first = days[dt.date(2019, 12, 30)]
    assert (first.iso_year, first.week_of_year, first.iso_week_number) == (2020, 1, "2020-W01")
    assert (first.day_name, first.month_name) == ("Monday   ", "December ")
    leap = days[dt.date(2020, 2, 29)]
    assert (leap.is_last_day_of_month_flag, leap.is_weekend_flag, leap.day_of_week_numeric) == (1, 1, 6)
