"""Staging tables, dimensions, facts and marts."""

from oracle.base import PARTS, avg, days, initcap, label, m, pct, q, r2, steps, typed
from oracle import raw as _raw  # noqa: F401

PARTS["stg_orders"] = f"""
select order_id, customer_id as order_customer_id, {initcap("order_status")} as order_status,
  order_purchase_timestamp as order_purchase_datetime, order_approved_at as order_approved_datetime,
  order_delivered_carrier_date as order_delivered_carrier_datetime,
  order_delivered_customer_date as order_delivered_customer_datetime,
  order_estimated_delivery_date as order_estimated_delivery_datetime
from raw_orders where order_id is not null and customer_id is not null
"""
PARTS["stg_order_items"] = """
select order_id, order_item_id, product_id, seller_id, shipping_limit_date as shipping_limit_datetime,
  price as item_price, freight_value as item_freight_value
from raw_order_items where order_id is not null and product_id is not null
"""
PARTS["stg_order_payments"] = f"""
select order_id, payment_sequential as payment_type_sequence, {label("payment_type")} as payment_type,
  coalesce(nullif(payment_installments, 0), case when payment_installments = 0 then 1 end)
    as payment_installment_count, payment_value
from raw_order_payments where order_id is not null
"""
PARTS["stg_reviews"] = """
select review_id, order_id, review_score, review_comment_title, review_comment_message,
  review_creation_date as review_creation_datetime, review_answer_timestamp as review_answer_datetime
from raw_order_reviews where review_id is not null and order_id is not null
"""
PARTS["stg_customers"] = f"""
select customer_unique_id as customer_id, customer_id as order_customer_id,
  customer_zip_code_prefix as customer_zip_code, {initcap("customer_city")} as customer_city,
  upper(customer_state) as customer_state
from raw_customers where customer_unique_id is not null and raw_customers.customer_id is not null
"""
PARTS["stg_geolocation"] = f"""
select geolocation_zip_code_prefix as zip_code, {initcap("geolocation_city")} as city,
  upper(geolocation_state) as state
from raw_geolocation where geolocation_zip_code_prefix is not null
"""
PARTS["stg_products"] = f"""
select product_id, {label("product_category_name")} as product_category,
  product_name_lenght as product_name_length, product_description_lenght as product_description_length,
  product_photos_qty, product_weight_g as product_weight_gm, product_length_cm, product_height_cm,
  product_width_cm
from raw_products where product_id is not null
"""
PARTS["stg_product_category_translation"] = f"""
select {label("product_category_name")} as product_category_name,
  {label("product_category_name_english")} as product_category_name_english
from raw_category_translation where raw_category_translation.product_category_name is not null
"""
PARTS["stg_sellers"] = f"""
select seller_id, seller_zip_code_prefix as seller_zip_code, {initcap("seller_city")} as seller_city,
  {initcap("seller_state")} as seller_state
from raw_sellers where seller_id is not null
"""
PARTS["stg_marketing_qualified_leads"] = f"""
select mql_id, cast(first_contact_date as date) as mql_first_contact_date,
  landing_page_id as mql_landing_page_id, {label("origin")} as mql_origin_category
from raw_marketing_qualified_leads where mql_id is not null
"""


def parsed_date(column: str) -> str:
    """Date text of the three shapes that occur in the sample."""
    return f"""coalesce(try_strptime({column}, '%Y-%m-%d %H:%M:%S'),
      try_strptime({column}, '%m/%d/%Y %H:%M'), try_strptime({column}, '%Y-%m-%d'))"""


PARTS["stg_closed_deals"] = f"""
select mql_id, seller_id, sdr_id, sr_id,
  -- a one-digit day behind a one- or two-digit month is padded, so all month-first texts parse
  {parsed_date("won_date")} as deal_closed_datetime,
  {label("business_segment")} as lead_business_segment,
  case when lead_type[1:6] = 'online' then 'Online' when lead_type = 'offline' then 'Offline' end
    as lead_business_channel_category,
  case when lead_type in ('other', 'industry') then {initcap("lead_type")}
    when lead_type[1:7] = 'online_' then {initcap("lead_type[8:]")} end as lead_business_tier,
  {initcap("lead_behaviour_profile")} as lead_behaviour_profile_category, has_company, has_gtin,
  average_stock as lead_business_average_stock, {initcap("business_type")} as lead_business_category,
  declared_product_catalog_size as lead_business_product_catalog_size,
  declared_monthly_revenue as lead_business_monthly_revenue
from raw_closed_deals where mql_id is not null and seller_id is not null
"""

PARTS["dim_customers"] = """
select distinct customer_id, order_customer_id, customer_zip_code,
  coalesce(city, customer_city) as customer_city, coalesce(state, customer_state) as customer_state
from stg_customers left join stg_geolocation on zip_code = customer_zip_code
"""
PARTS["dim_sellers"] = """
select seller_id, seller_zip_code, coalesce(city, seller_city) as seller_city,
  coalesce(state, seller_state) as seller_state
from stg_sellers left join stg_geolocation on zip_code = seller_zip_code
"""
PARTS["dim_products"] = """
select p.* exclude (product_category), t.product_category_name_english as product_category
from stg_products p left join stg_product_category_translation t
  on t.product_category_name = p.product_category
"""
PARTS["dim_location"] = """
select zip_code, city, state,
  coalesce((select any_value(r) from (values ('Southeast', 'RJ SP ES MG'), ('South', 'PR SC RS'),
     ('Central-West', 'GO DF'), ('North', 'AM RR AP PA TO AC'),
     ('Northeast', 'CE RN PE AL SE BA PI MA')) as t(r, s)
    where list_contains(string_split(s, ' '), state)), 'Unknown') as region,
  case when lower(city) = 'brasília' then 'Brasília'
    when lower(city) in ('são paulo', 'rio de janeiro', 'belo horizonte', 'salvador', 'fortaleza',
      'recife', 'porto alegre', 'curitiba', 'manaus')
    then case lower(city) when 'rio de janeiro' then 'Rio de Janeiro' else city end || ' Metro'
    else 'Non-Metro' end as metro_area,
  state || '_' || row_number() over (partition by state order by city, zip_code)
    as geographic_region_id,
  timestamp '2018-12-31 00:00:00' as created_at
from (select distinct zip_code, city, state from stg_geolocation)
"""
PARTS["dim_date"] = """
select d as calendar_date, year(d) as calendar_year, month(d) as calendar_month,
  quarter(d) as calendar_quarter, day(d) as day_of_month, dayofweek(d) as day_of_week_numeric,
  isodow(d) as iso_day_of_week, dayofyear(d) as day_of_year, weekofyear(d) as week_of_year,
  isoyear(d) as iso_year, strftime(d, '%G-W%V') as iso_week_number,
  rpad(dayname(d), 9, ' ') as day_name, strftime(d, '%a') as day_abbreviation,
  rpad(monthname(d), 9, ' ') as month_name, strftime(d, '%b') as month_abbreviation,
  year(d) as fiscal_year, quarter(d) as fiscal_quarter, month(d) as fiscal_month,
  isodow(d) > 5 as is_weekend_flag, isodow(d) < 6 as is_weekday_flag,
  isodow(d) < 6 as is_business_day_flag, day(d) = 1 as is_first_day_of_month_flag,
  day(d + 1) = 1 as is_last_day_of_month_flag, isodow(d) = 1 as is_monday_flag,
  isodow(d) = 5 as is_friday_flag, isodow(d) = 1 as is_week_start_flag,
  isodow(d) = 7 as is_week_end_flag, month(d) % 3 = 1 and day(d) = 1 as is_quarter_start_flag,
  strftime(d, '%m-%d') = '01-01' as is_year_start_flag,
  strftime(d, '%m-%d') = '12-31' as is_year_end_flag, d - date '1970-01-01' as days_since_epoch
from (
  select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d
  from (select date_trunc('day', min(order_purchase_datetime)) as lo,
      date_trunc('day', max(order_purchase_datetime)) + interval 1 year as hi from stg_orders))
"""


def _hours(a: str, b: str) -> str:
    return f"(epoch_us({a}) - epoch_us({b})) / 1e6 / 3600"


PARTS["fact_orders"] = f"""
select o.order_id, c.customer_id, o.order_status, coalesce(i.n, 0) as order_item_count,
  coalesce(i.price, 0) as order_item_price_total, coalesce(i.freight, 0) as order_freight_total,
  coalesce(i.total, 0) as order_total, coalesce(p.sequences, 0) as payment_count,
  coalesce(p.types, 0) as payment_method_type_count,
  coalesce(p.installments, 0) as payment_installment_count, coalesce(p.paid, 0) as payment_total,
  coalesce(r.n, 0) as review_count, r.score as avg_review_score, r.hi as max_review_score,
  r.lo as min_review_score,
  case when o.order_delivered_customer_datetime is null then null else cast(coalesce(
    o.order_delivered_customer_datetime <= o.order_estimated_delivery_datetime, false) as bigint)
    end as on_time_delivery_flag,
  {_hours("order_approved_datetime", "order_purchase_datetime")} as time_to_approval_hours,
  {_hours("order_delivered_carrier_datetime", "order_purchase_datetime")} as time_to_ship_hours,
  {_hours("order_delivered_customer_datetime", "order_purchase_datetime")} as time_to_deliver_hours,
  {_hours("order_delivered_customer_datetime", "order_estimated_delivery_datetime")}
    as delivery_estimation_slip_hours,
  order_purchase_datetime, order_approved_datetime, order_delivered_carrier_datetime,
  order_delivered_customer_datetime, order_estimated_delivery_datetime
from stg_orders o
left join (select order_id, count(order_item_id) as n, {m("sum(item_price)")} as price,
    {m("sum(item_freight_value)")} as freight,
    {m("sum(item_price) + sum(item_freight_value)")} as total
  from stg_order_items group by 1) i on i.order_id = o.order_id
left join (select order_id, count(distinct payment_type_sequence) as sequences,
    count(distinct payment_type) as types, max(payment_installment_count) as installments,
    {m("sum(payment_value)")} as paid
  from stg_order_payments group by 1) p on p.order_id = o.order_id
left join (select order_id, count(*) as n, {avg("review_score")} as score,
    max(review_score) as hi, min(review_score) as lo
  from stg_reviews group by 1) r on r.order_id = o.order_id
left join dim_customers c on c.order_customer_id = o.order_customer_id
"""
PARTS["fact_order_lines"] = """
select i.order_id, i.order_item_id, o.order_customer_id, o.order_status, i.product_id, i.seller_id,
  i.shipping_limit_datetime, i.item_price, i.item_freight_value, r.review_score
from stg_order_items i left join stg_orders o using (order_id)
  left join stg_reviews r on r.order_id = o.order_id
"""
PARTS["fact_payments"] = """
select p.order_id, concat(p.order_id, '_', payment_type_sequence) as payment_id,
  payment_type_sequence, payment_type, payment_value, payment_installment_count,
  order_purchase_datetime as payment_date,
  count_if(order_status in ('Canceled', 'Unavailable')) over (partition by p.order_id,
    payment_type_sequence) as is_refunded,
  timestamp '2018-12-31 00:00:00' as created_at
from stg_order_payments p left join stg_orders o on o.order_id = p.order_id
"""
PARTS["fact_reviews"] = """
select review_id, r.order_id, order_customer_id as customer_id, review_score, review_comment_title,
  review_comment_message, length(coalesce(review_comment_message, '')) as review_comment_length,
  cast(review_comment_message is not null as bigint) as has_comment_flag,
  review_creation_datetime as review_date, review_answer_datetime, order_purchase_datetime,
  (epoch_us(review_creation_datetime) - epoch_us(order_purchase_datetime)) // 86400000000
    as days_to_review,
  timestamp '2018-12-31 00:00:00' as created_at
from stg_reviews r left join stg_orders o on o.order_id = r.order_id
"""
PARTS["fact_closed_deals"] = """
select d.mql_id, seller_id, sdr_id, sr_id,
  if(l.mql_id is null, 'orphaned', 'linked') as mql_link_status, mql_first_contact_date,
  deal_closed_datetime,
  trunc((epoch_us(deal_closed_datetime) - epoch_us(cast(mql_first_contact_date as timestamp)))
    / 86400e6) as days_to_close,
  mql_landing_page_id, mql_origin_category, lead_business_segment, lead_business_category,
  lead_behaviour_profile_category, has_company, has_gtin, lead_business_average_stock,
  lead_business_product_catalog_size, lead_business_monthly_revenue
from stg_closed_deals d left join stg_marketing_qualified_leads l on l.mql_id = d.mql_id
"""
PARTS["order_days"] = """
select *, cast(order_purchase_datetime as date) as day,
  (select max(cast(order_purchase_datetime as date)) from stg_orders) as today
from fact_orders
"""
PARTS["lines_with_orders"] = """
select l.*, o.day, o.today, o.customer_id, o.order_total, o.payment_total,
  o.order_purchase_datetime, o.order_delivered_customer_datetime,
  o.order_estimated_delivery_datetime, o.order_id is not null as found
from fact_order_lines l left join order_days o on o.order_id = l.order_id
"""
PARTS["fact_product_daily_metrics"] = f"""
select product_id, day as order_date, count(distinct order_id) as units_sold,
  0 as units_refunded, {m("sum(item_price)")} as gross_revenue,
  {m("sum(item_freight_value)")} as freight_revenue,
  {m("sum(item_price) + sum(item_freight_value)")} as total_revenue,
  count(distinct customer_id) as distinct_buyers, count(distinct seller_id) as distinct_sellers,
  {avg("review_score")} as avg_review_score,
  count(distinct order_id) filter (review_score is not null) as review_count,
  {m("min(item_price)")} as price_min, {avg("item_price")} as price_avg,
  {m("max(item_price)")} as price_max,
  {pct("sum(item_freight_value)", "sum(item_price)")} as freight_cost_pct_of_revenue,
  timestamp '2018-12-31 00:00:00' as created_at
from lines_with_orders
where order_status <> 'Canceled' and order_status <> 'Unavailable'
group by product_id, day
"""
PARTS["bridge_product_seller"] = f"""
select product_id, seller_id, min(day) as first_sale_date, max(day) as last_sale_date,
  count(distinct order_id) as total_orders, count(*) as total_line_items,
  {m("sum(item_price)")} as total_revenue, {m("sum(item_freight_value)")} as total_freight_cost,
  {m("sum(item_price) + sum(item_freight_value)")} as total_revenue_with_freight,
  {avg("item_price")} as avg_item_price, {avg("review_score")} as avg_review_score,
  count(distinct order_id) as order_count,
  (select max(today) from order_days) - max(day) as days_since_last_sale
from lines_with_orders group by product_id, seller_id
"""
PARTS["agg_daily_sales"] = f"""
select day as order_date, count(order_id) as total_order_count,
  sum(cast(order_status = 'Canceled' as int)) as canceled_order_count,
  sum(cast(order_status = 'Unavailable' as int)) as unavailable_order_count,
  {m("sum(order_total)")} as total_order_value, {m("sum(payment_total)")} as total_paid,
  {m("coalesce(sum(payment_total) filter (order_status = 'Canceled'), 0)")} as lost_revenue_canceled,
  {m("coalesce(sum(payment_total) filter (order_status = 'Unavailable'), 0)")}
    as lost_revenue_unavailable,
  {avg("avg_review_score")} as avg_review_score
from order_days group by day
"""
PARTS["order_details_wide"] = """
select l.order_id, l.order_item_id, l.shipping_limit_datetime, l.item_price, l.item_freight_value,
  l.review_score, l.product_id, l.seller_id, l.order_customer_id as customer_id, o.* exclude (order_id,
    customer_id, review_count, max_review_score, min_review_score, on_time_delivery_flag)
from fact_order_lines l left join fact_orders o on o.order_id = l.order_id
"""

_STATUS = [(30, "Active"), (90, "At Risk"), (180, "Churning")]

PARTS["agg_customer_performance"] = f"""
select *, {steps("days_since_last_purchase", _STATUS, "Churned", "<=")} as customer_status,
  {steps("avg_monthly_spend", [(1000, "High Value"), (500, "Medium Value")], "Low Value")}
    as customer_value_tier
from (
  select customer_id, min(day) as first_purchase_date, max(day) as last_purchase_date,
    max(today) - max(day) as days_since_last_purchase,
    max(day) - min(day) as customer_lifetime_days,
    {m("sum(order_total)")} as life_time_customer_value, {avg("order_total")} as avg_order_value,
    count(order_id) as total_order_count,
    count(*) filter (order_status = 'Canceled') as canceled_order_count,
    count(*) filter (order_status = 'Unavailable') as unavailable_order_count,
    {m("coalesce(sum(payment_total) filter (order_status = 'Canceled'), 0)")}
      as lost_revenue_canceled,
    {m("coalesce(sum(payment_total) filter (order_status = 'Unavailable'), 0)")}
      as lost_revenue_unavailable,
    {avg("avg_review_score")} as avg_review_score,
    {m(r2(q("count(order_id)", "max(day) - min(day)") + " * 30"))} as avg_monthly_orders,
    {m(r2(q("sum(order_total)", "max(day) - min(day)") + " * 30"))} as avg_monthly_spend,
    {pct("count(*) filter (order_status in ('Canceled', 'Unavailable'))", "count(order_id)")}
      as problem_order_rate,
    {m(r2("stddev_samp(cast(order_total as double))"))} as order_value_stddev,
    {pct("count(*) filter (avg_review_score >= 4)", "count(avg_review_score)")}
      as positive_review_rate
  from order_days group by customer_id)
"""
PARTS["customer_segments"] = """
select customer_id, r_score, f_score, m_score, concat(r_score, f_score, m_score) as rfm_segment_score,
  case when r_score >= 4 then
      case when f_score >= 4 and m_score >= 4 then 'High-Value Loyal'
        when f_score >= 3 and m_score >= 3 then 'Loyal Customers'
        when f_score <= 2 and m_score <= 2 then 'New Customers'
        when f_score <= 2 and m_score >= 3 then 'Promising' else 'Other' end
    when r_score <= 2 then
      case when f_score >= 4 and m_score >= 4 then 'At-Risk Loyal'
        when f_score <= 2 and m_score <= 2 then 'Churned / Lost'
        when f_score >= 3 and m_score <= 2 then 'Needs Attention' else 'Other' end
    when f_score <= 2 and m_score >= 3 then 'Promising' else 'Other' end as customer_segment
from (
  select customer_id,
    ntile(5) over (order by days_since_last_purchase asc nulls last, tie, customer_id) as r_score,
    ntile(5) over (order by total_order_count desc nulls first, tie, customer_id) as f_score,
    ntile(5) over (order by life_time_customer_value desc nulls first, tie, customer_id) as m_score
  from (select *, coalesce(md5(cast(customer_id as varchar)), '') as tie
    from agg_customer_performance))
"""
PARTS["kept_orders"] = """
select customer_id, count(distinct order_id) as n, min(day) as first_day, max(day) as last_day,
  max(day) - min(day) as span, max(today) as today, sum(order_total) as total, count(order_total) as c
from order_days where order_status not in ('Canceled', 'Unavailable') group by customer_id
"""
PARTS["agg_customer_churn_risk"] = f"""
select customer_id, first_day as first_purchase_date, last_day as last_purchase_date,
  today - last_day as days_since_last_purchase,
  case when n > 1 then span // nullif(n - 1, 0) end as avg_days_between_purchases,
  case when n > 1 then last_day + cast(span // nullif(n - 1, 0) as integer) end
    as expected_next_purchase_date,
  n as total_purchase_count, {m(r2(q("total", "c")))} as avg_order_value,
  {m("total")} as total_lifetime_value, score as churn_risk_score, score as churn_probability_pct,
  {steps("score", [(75, "very_high"), (60, "high"), (40, "medium")], "low")} as churn_risk_tier,
  greatest(180 - (today - last_day), 0) as days_until_churn_threshold
from (select *, {steps("today - last_day", [(30, 5), (60, 15), (90, 25), (180, 35)], 40, "<=")}
    + {steps("n", [(10, 2), (5, 8), (3, 15), (1, 25)], 30)}
    + {steps("total", [(1000, 2), (500, 8), (200, 15), (100, 23)], 30)} as score
  from kept_orders)
"""
PARTS["agg_customer_repurchase_metrics"] = f"""
select customer_id, n as total_purchases, cast(n > 1 as bigint) as is_repeat_customer,
  case when n > 1 then {pct("n - 1", "n")} else 0 end as repeat_purchase_rate,
  case when n > 1 then {m(r2(q("span", "n - 1")))} end as avg_days_between_purchases,
  case when n > 1 then ceil({q("span", "n - 1")} / 2) end as first_repeat_purchase_days,
  {m("total")} as repeat_customer_lifetime_value, {m(r2(q("total", "c")))} as avg_repeat_order_value,
  last_day as last_purchase_date,
  {steps("n", [(10, "high_frequency"), (5, "medium_frequency"), (3, "occasional")], "one_time")}
    as purchase_count_tier,
  case when n = 1 then 10 else {steps("n", [(10, 95), (5, 80), (3, 60)], 30)} end
    as repurchase_probability_pct
from kept_orders
"""
PARTS["agg_seller_performance"] = f"""
select seller_id, min(day) as first_sale_date, max(day) as last_sale_date,
  max(today) - max(day) as days_since_last_sale,
  {m("sum(order_total)")} as life_time_seller_sales_value, {avg("order_total")} as avg_sale_value,
  count(distinct order_id) as total_order_count,
  count_if(order_status = 'Canceled') as canceled_order_count,
  count_if(order_status = 'Unavailable') as unavailable_order_count,
  {m("sum(if(order_status = 'Canceled', payment_total, 0))")} as lost_revenue_canceled,
  {m("sum(if(order_status = 'Unavailable', payment_total, 0))")} as lost_revenue_unavailable,
  {avg("review_score")} as avg_review_score,
  {m(r2(q(q("count(distinct order_id)", "max(today) - min(day)"), "30")))} as avg_monthly_orders,
  {m(r2(q(q("sum(order_total)", "max(today) - min(day)"), "30")))} as avg_monthly_revenue,
  {pct("count_if(order_status in ('Canceled', 'Unavailable'))", "count(distinct order_id)")}
    as order_problem_rate,
  {steps("max(today) - max(day)", _STATUS, "Churned", "<=")} as seller_status
from lines_with_orders where found group by seller_id
"""
PARTS["agg_seller_health_scorecard"] = f"""
select *, performance_score_ as performance_score,
  {steps("performance_score_", [(85, "low"), (65, "medium")], "high")} as risk_tier,
  case when on_time_delivery_rate < 95 then ceil((95 - on_time_delivery_rate) / 5) else 0 end
    as days_to_improvement_target,
  case when performance_score_ >= 85 then 'maintain' when performance_score_ >= 65 then 'monitor'
    when on_time_delivery_rate < 85 then 'improve_delivery'
    when avg_review_score < 3.5 then 'improve_quality' else 'investigate' end as recommended_action
from (
  select *, delivery_quality_score + customer_satisfaction_score + fulfillment_score
    as performance_score_
  from (
    select *,
      {steps("on_time_delivery_rate", [(95, 40), (90, 35), (85, 30), (80, 25), (75, 20), (70, 15), (60, 10)], 5)}
        as delivery_quality_score,
      {steps("avg_review_score", [(4.7, 35), (4.5, 32), (4.3, 28), (4.0, 24), (3.7, 18), (3.5, 12)], 5)}
        as customer_satisfaction_score,
      {steps(q("completed_orders", "total_orders"), [(0.95, 25), (0.9, 22), (0.85, 18), (0.8, 14), (0.7, 10)], 5)}
        as fulfillment_score
    from (
      select seller_id, count(distinct order_id) as total_orders,
        count(distinct product_id) as unique_products_sold,
        count_if(order_status not in ('Canceled', 'Unavailable')) as completed_orders,
        count_if(order_status = 'Canceled') as canceled_orders,
        {m("sum(item_price)")} as total_revenue, {avg("payment_total")} as avg_order_value,
        {pct("count_if(order_delivered_customer_datetime <= order_estimated_delivery_datetime)", "count(*)")}
          as on_time_delivery_rate,
        {m(r2(q("sum(epoch_us(order_delivered_customer_datetime) - epoch_us(order_purchase_datetime)) / 1e6", "count(order_delivered_customer_datetime) * 3600")))}
          as avg_fulfillment_time_hours,
        {avg("review_score")} as avg_review_score,
        {pct("count(distinct order_id) filter (review_score >= 4)", "count(distinct order_id) filter (review_score is not null)")}
          as satisfaction_rate,
        min(day) as first_sale_date, max(day) as last_sale_date,
        (select max(today) from order_days) - min(day) as seller_tenure_days
      from lines_with_orders group by seller_id)))
"""
PARTS["agg_product_quality_metrics"] = f"""
select *, case when avg_rating >= 4.5 and satisfaction_rate >= 90 then 5
    when avg_rating >= 4 and satisfaction_rate >= 80 then 4
    when avg_rating >= 3.5 and satisfaction_rate >= 70 then 3
    when avg_rating >= 3 and satisfaction_rate >= 60 then 2 else 1 end as quality_tier,
  {steps("return_rate", [(5, 5), (10, 15), (15, 30), (20, 40)], 50, "<=")}
    + {steps("avg_rating", [(4.5, 0), (4.0, 10), (3.5, 20), (3.0, 35)], 50)} as defect_risk_score
from (
  select product_id, count(distinct order_id) filter (review_score is not null) as total_reviews,
    {avg("review_score")} as avg_rating,
    count_if(review_score = 5) as reviews_5_star, count_if(review_score = 4) as reviews_4_star,
    count_if(review_score = 3) as reviews_3_star, count_if(review_score = 2) as reviews_2_star,
    count_if(review_score = 1) as reviews_1_star,
    count(distinct order_id) filter (order_status = 'Canceled') as return_count,
    {pct("count(distinct order_id) filter (order_status = 'Canceled')", "count(distinct order_id)")}
      as return_rate,
    {pct("count_if(review_score >= 4)", "count(distinct order_id) filter (review_score is not null)")}
      as satisfaction_rate,
    count(distinct order_id) as total_orders
  from lines_with_orders group by product_id)
"""
PARTS["agg_marketing_channel_performance"] = f"""
select channel, mql_count, deals_closed,
  case when mql_count > 0 then {m(r2("conversion"))} else 0 end as mql_to_deal_conversion_rate,
  avg_days_to_close, avg_deal_value, unique_sellers,
  {m(r2(q("declared", "mql_count")))} as seller_ltv_vs_declared_revenue,
  {m(r2(q("deals_closed * deal_value", "mql_count")))} as channel_roi,
  {steps("conversion", [(15, 40), (10, 30), (5, 20)], 10)}
    + {steps("coalesce(avg_days_to_close, 0)", [(30, 35), (60, 25), (90, 15)], 5, "<=")}
    + {steps("deal_value", [(10000, 25), (5000, 18), (1000, 10)], 5)} as quality_score
from (
  select channel, coalesce(leads, 0) as mql_count, coalesce(deals, 0) as deals_closed,
    {q("coalesce(deals, 0)", "coalesce(leads, 0)")} * 100 as conversion, avg_days_to_close,
    avg_deal_value, coalesce(avg_deal_value, 0) as deal_value, unique_sellers,
    coalesce(declared, 0) as declared
  from (select mql_origin_category as channel, count(distinct mql_id) as leads
      from stg_marketing_qualified_leads where mql_origin_category is not null group by 1)
    full join (select mql_origin_category as channel, count(distinct mql_id) as deals,
        count(distinct seller_id) as unique_sellers,
        {m("sum(lead_business_monthly_revenue)")} as declared,
        {avg("lead_business_monthly_revenue")} as avg_deal_value,
        {avg("days_to_close")} as avg_days_to_close
      from fact_closed_deals
      where mql_link_status = 'linked' and mql_origin_category is not null group by 1)
    using (channel))
"""
PARTS["mql_details_wide"] = f"""
select *, case when ratio_ >= 1.2 then 'Exceptional Performance' when ratio_ >= 1 then 'Above Expectations'
    when ratio_ >= 0.8 then 'Meeting Expectations' when ratio_ >= 0.5 then 'Underperforming'
    else 'Severely Underperforming' end as revenue_performance_category,
  ratio_ as actual_vs_declared_revenue_ratio
from (
  select d.mql_id, d.seller_id, mql_first_contact_date, deal_closed_datetime, days_to_close,
    mql_origin_category, lead_business_segment, lead_business_category,
    lead_behaviour_profile_category, lead_business_monthly_revenue as declared_monthly_revenue,
    lead_business_product_catalog_size as declared_catalog_size,
    lead_business_average_stock as declared_avg_stock, has_company, has_gtin, first_sale_date,
    last_sale_date, days_since_last_sale, life_time_seller_sales_value, avg_sale_value,
    lost_revenue_canceled, lost_revenue_unavailable, avg_review_score, seller_status,
    first_sale_date - cast(deal_closed_datetime as date) as days_to_first_sale,
    avg_monthly_orders, avg_monthly_revenue, order_problem_rate,
    {m(r2(q("life_time_seller_sales_value", "lead_business_monthly_revenue")))} as ratio_
  from fact_closed_deals d left join agg_seller_performance s on s.seller_id = d.seller_id)
"""

# Output types: model -> (double columns, bigint columns, helper columns left out).
_ORDER_MONEY = "order_item_price_total order_freight_total order_total payment_total avg_review_score"
_ORDER_HOURS = (
    "time_to_approval_hours time_to_ship_hours time_to_deliver_hours delivery_estimation_slip_hours"
)
_PRODUCT_SIZES = (
    "product_name_length product_description_length product_photos_qty product_weight_gm "
    "product_length_cm product_height_cm product_width_cm"
)
OUTPUT: dict[str, tuple[str, str, str]] = {
    "stg_orders": ("", "order_id order_customer_id", ""),
    "stg_order_items": (
        "item_price item_freight_value",
        "order_id order_item_id product_id seller_id",
        "",
    ),
    "stg_order_payments": (
        "payment_value",
        "order_id payment_type_sequence payment_installment_count",
        "",
    ),
    "stg_reviews": ("", "review_id order_id review_score", ""),
    "stg_customers": ("", "customer_id order_customer_id customer_zip_code", ""),
    "stg_geolocation": ("", "zip_code", ""),
    "stg_products": ("", f"product_id {_PRODUCT_SIZES}", ""),
    "stg_product_category_translation": ("", "", ""),
    "stg_sellers": ("", "seller_id seller_zip_code", ""),
    "stg_marketing_qualified_leads": ("", "mql_id mql_landing_page_id", ""),
    "stg_closed_deals": (
        "lead_business_product_catalog_size lead_business_monthly_revenue",
        "mql_id seller_id sdr_id sr_id",
        "",
    ),
    "dim_customers": ("", "customer_id order_customer_id customer_zip_code", ""),
    "dim_sellers": ("", "seller_id seller_zip_code", ""),
    "dim_products": ("", f"product_id {_PRODUCT_SIZES}", ""),
    "dim_location": ("", "zip_code", ""),
    "dim_date": (
        "",
        "calendar_year calendar_month calendar_quarter day_of_month day_of_week_numeric "
        "iso_day_of_week day_of_year week_of_year iso_year fiscal_year fiscal_quarter fiscal_month "
        "is_weekend_flag is_weekday_flag is_business_day_flag is_first_day_of_month_flag "
        "is_last_day_of_month_flag is_monday_flag is_friday_flag is_week_start_flag "
        "is_week_end_flag is_quarter_start_flag is_year_start_flag is_year_end_flag "
        "days_since_epoch",
        "",
    ),
    "fact_orders": (
        f"{_ORDER_MONEY} {_ORDER_HOURS}",
        "order_id customer_id order_item_count payment_count payment_method_type_count "
        "payment_installment_count review_count max_review_score min_review_score "
        "on_time_delivery_flag",
        "",
    ),
    "fact_order_lines": (
        "item_price item_freight_value",
        "order_id order_item_id order_customer_id product_id seller_id review_score",
        "",
    ),
    "fact_payments": (
        "payment_value",
        "order_id payment_type_sequence payment_installment_count is_refunded",
        "",
    ),
    "fact_reviews": (
        "",
        "review_id order_id customer_id review_score review_comment_length has_comment_flag "
        "days_to_review",
        "",
    ),
    "fact_closed_deals": (
        "lead_business_product_catalog_size lead_business_monthly_revenue",
        "mql_id seller_id sdr_id sr_id mql_landing_page_id days_to_close",
        "",
    ),
    "fact_product_daily_metrics": (
        "gross_revenue freight_revenue total_revenue avg_review_score price_min price_avg price_max "
        "freight_cost_pct_of_revenue",
        "product_id units_sold units_refunded distinct_buyers distinct_sellers review_count",
        "",
    ),
    "bridge_product_seller": (
        "total_revenue total_freight_cost total_revenue_with_freight avg_item_price avg_review_score",
        "product_id seller_id total_orders total_line_items order_count days_since_last_sale",
        "",
    ),
    "agg_daily_sales": (
        "total_order_value total_paid lost_revenue_canceled lost_revenue_unavailable "
        "avg_review_score",
        "total_order_count canceled_order_count unavailable_order_count",
        "",
    ),
    "order_details_wide": (
        f"item_price item_freight_value {_ORDER_MONEY} {_ORDER_HOURS}",
        "order_id order_item_id review_score product_id seller_id customer_id order_item_count "
        "payment_count payment_method_type_count payment_installment_count",
        "",
    ),
    "agg_customer_performance": (
        "life_time_customer_value avg_order_value lost_revenue_canceled lost_revenue_unavailable "
        "avg_review_score avg_monthly_orders avg_monthly_spend problem_order_rate "
        "order_value_stddev positive_review_rate",
        "customer_id days_since_last_purchase customer_lifetime_days total_order_count "
        "canceled_order_count unavailable_order_count",
        "",
    ),
    "customer_segments": ("", "customer_id r_score f_score m_score", ""),
    "agg_customer_churn_risk": (
        "avg_days_between_purchases avg_order_value total_lifetime_value churn_probability_pct",
        "customer_id days_since_last_purchase total_purchase_count churn_risk_score "
        "days_until_churn_threshold",
        "",
    ),
    "agg_customer_repurchase_metrics": (
        "repeat_purchase_rate avg_days_between_purchases repeat_customer_lifetime_value "
        "avg_repeat_order_value repurchase_probability_pct",
        "customer_id total_purchases is_repeat_customer first_repeat_purchase_days",
        "",
    ),
    "agg_seller_performance": (
        "life_time_seller_sales_value avg_sale_value lost_revenue_canceled lost_revenue_unavailable "
        "avg_review_score avg_monthly_orders avg_monthly_revenue order_problem_rate",
        "seller_id days_since_last_sale total_order_count canceled_order_count "
        "unavailable_order_count",
        "",
    ),
    "agg_seller_health_scorecard": (
        "total_revenue avg_order_value on_time_delivery_rate avg_fulfillment_time_hours "
        "avg_review_score satisfaction_rate",
        "seller_id total_orders unique_products_sold completed_orders canceled_orders "
        "seller_tenure_days delivery_quality_score customer_satisfaction_score fulfillment_score "
        "performance_score days_to_improvement_target",
        "performance_score_",
    ),
    "agg_product_quality_metrics": (
        "avg_rating return_rate satisfaction_rate",
        "product_id total_reviews reviews_5_star reviews_4_star reviews_3_star reviews_2_star "
        "reviews_1_star return_count total_orders quality_tier defect_risk_score",
        "",
    ),
    "agg_marketing_channel_performance": (
        "mql_to_deal_conversion_rate avg_days_to_close avg_deal_value "
        "seller_ltv_vs_declared_revenue channel_roi",
        "mql_count deals_closed unique_sellers quality_score",
        "",
    ),
    "mql_details_wide": (
        "declared_monthly_revenue declared_catalog_size life_time_seller_sales_value avg_sale_value "
        "lost_revenue_canceled lost_revenue_unavailable avg_review_score avg_monthly_orders "
        "avg_monthly_revenue order_problem_rate actual_vs_declared_revenue_ratio",
        "mql_id seller_id days_to_close days_since_last_sale days_to_first_sale",
        "ratio_",
    ),
}


def model_statements() -> dict[str, str]:
    return {name: typed(name, *spec) for name, spec in OUTPUT.items()}
