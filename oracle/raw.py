"""Canonical raw tables over the sample tables."""

from oracle.base import PARTS

_CENTS = "cast(round(cast({} as decimal(38,10)), 2) as decimal(18,2))"

PARTS["raw_orders"] = """
select o_orderkey as order_id, o_orderkey as customer_id,
  case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else
    case o_orderpriority when '1-URGENT' then 'canceled' when '2-HIGH' then 'unavailable'
      else 'processing' end end as order_status,
  o_orderdate + to_minutes(o_orderkey % 1440) as order_purchase_timestamp,
  case when o_orderkey % 41 <> 0 then
    o_orderdate + to_minutes(o_orderkey % 1440) + to_hours(o_orderkey % 48) end as order_approved_at,
  case when o_orderstatus <> 'P' then
    o_orderdate + to_hours(24 + o_orderkey * 5 % 150) end as order_delivered_carrier_date,
  case when o_orderstatus = 'F' then
    o_orderdate + to_hours(72 + o_orderkey * 7 % 600) end as order_delivered_customer_date,
  o_orderdate + to_days(20) as order_estimated_delivery_date
from orders
"""

PARTS["raw_order_items"] = f"""
select order_id, order_item_id, product_id, seller_id, shipping_limit_date, price,
  cast(round(price * cast(tax as decimal(4,2)), 2) as decimal(18,2)) as freight_value
from (
  select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id,
    l_suppkey as seller_id, l_shipdate as shipping_limit_date,
    {_CENTS.format("l_extendedprice / 2000")} as price, l_tax as tax
  from lineitem)
"""

PARTS["raw_order_payments"] = f"""
select o_orderkey as order_id, 1 as payment_sequential,
  ['credit_card', 'boleto', 'debit_card', 'voucher'][o_orderkey % 4 + 1] as payment_type,
  cast(o_orderkey % 11 as integer) as payment_installments,
  {_CENTS.format("o_totalprice / 2000")} as payment_value
from orders where o_orderkey % 113 <> 0
union all
select o_orderkey, 2, 'voucher', 1, cast(25 as decimal(18,2)) from orders where o_orderkey % 5 = 0
"""

PARTS["raw_order_reviews"] = """
select o_orderkey * 10 as review_id, o_orderkey as order_id,
  case when o_orderkey * 7 % 10 < 5 then 5 when o_orderkey * 7 % 10 = 5 then 4
    else cast(o_orderkey * 7 % 10 - 5 as integer) end as review_score,
  cast(null as varchar) as review_comment_title, text as review_comment_message,
  o_orderdate + to_days(25) as review_creation_date,
  o_orderdate + to_days(27) as review_answer_timestamp
from orders left join documents on doc_id = o_orderkey where o_orderkey % 10 <> 3
union all
select o_orderkey * 10 + 1, o_orderkey, cast(1 + o_orderkey % 5 as integer), null, null,
  o_orderdate + to_days(30), o_orderdate + to_days(32)
from orders where o_orderkey % 50 = 0
"""

PARTS["raw_customers"] = """
select o_orderkey as customer_id, o_custkey as customer_unique_id,
  cast(c_custkey % 200 as integer) as customer_zip_code_prefix,
  lower(n_name) as customer_city, lower(r_name[1:2]) as customer_state
from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderkey % 97 <> 0
"""

PARTS["raw_geolocation"] = """
select distinct cast(c_custkey % 200 as integer) as geolocation_zip_code_prefix,
  string_split('rio de janeiro,são paulo,vitória,belo horizonte,curitiba,joinville,porto alegre,goiânia,brasília,manaus,boa vista,macapá,belém,palmas,rio branco,fortaleza,natal,recife,maceió,aracaju,salvador,teresina,são luís,cuiabá,porto velho', ',')[c_custkey % 200 % 25 + 1] as geolocation_city,
  string_split('rj sp es mg pr sc rs go df am rr ap pa to ac ce rn pe al se ba pi ma mt ro', ' ')[c_custkey % 200 % 25 + 1] as geolocation_state
from customer where c_custkey % 200 < 190
"""

PARTS["raw_products"] = """
select p_partkey as product_id, lower(p_type) || '_goods' as product_category_name,
  length(p_name) as product_name_lenght, p_size * 20 as product_description_lenght,
  p_partkey % 7 as product_photos_qty, p_size * 100 as product_weight_g,
  p_size + 10 as product_length_cm, p_size + 5 as product_height_cm, p_size + 8 as product_width_cm
from part
"""

PARTS["raw_category_translation"] = """
select distinct lower(p_type) || '_goods' as product_category_name,
  'eng_' || lower(p_type) as product_category_name_english
from part where lower(p_type) <> 'promo'
"""

PARTS["raw_sellers"] = """
select s_suppkey as seller_id, s_suppkey % 200 as seller_zip_code_prefix,
  lower(n_name) as seller_city, lower(r_name[1:2]) as seller_state
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

PARTS["raw_marketing_qualified_leads"] = """
select event_id as mql_id, cast(ts as date) as first_contact_date, user_id as landing_page_id,
  ['organic_search', 'paid_search', 'social', 'email', 'referral', null][event_id % 6 + 1] as origin
from events where event_type = 'signup'
"""

PARTS["raw_closed_deals"] = """
select event_id as mql_id, user_id % (select count(*) from supplier) as seller_id,
  event_id % 7 as sdr_id, event_id % 5 as sr_id,
  case event_id % 4
    when 0 then strftime(ts + to_days(cast(event_id % 120 as integer)), '%Y-%m-%d %H:%M:%S')
    when 1 then strftime(ts + to_days(cast(event_id % 120 as integer)), '%-m/%-d/%Y %-H:%M')
    when 2 then strftime(ts + to_days(cast(event_id % 120 as integer)), '%Y-%m-%d')
    else '' end as won_date,
  case event_id % 2 when 0 then 'home_decor' else 'pet' end as business_segment,
  ['online_beginner', 'online_small', 'online_medium', 'online_big', 'online_top', 'offline',
   'industry', 'other', null][event_id % 9 + 1] as lead_type,
  case event_id % 2 when 0 then 'cat' else 'wolf, shark' end as lead_behaviour_profile,
  event_id % 3 = 0 as has_company, event_id % 2 = 0 as has_gtin, '5-20' as average_stock,
  case event_id % 2 when 0 then 'reseller' else 'manufacturer' end as business_type,
  cast(event_id % 300 as double) as declared_product_catalog_size,
  cast(case when event_id % 8 = 0 then 0
    else round(cast(value * 1000 as decimal(38,10)), 0) end as decimal(18,2)) as declared_monthly_revenue
from events
where (event_type = 'signup' and event_id % 5 = 0) or (event_type = 'error' and event_id % 40 = 0)
"""
