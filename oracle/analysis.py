"""Sources and sinks, macros, checks, profiles, chart data, texts and vectors."""

from __future__ import annotations

from oracle import declared
from oracle.base import PARTS, statement, typed
from oracle.models import OUTPUT

SQL: dict[str, str] = {}


def _d(x: str, digits: int) -> str:
    """A floating result, cut to the digits that do not depend on the order of adding."""
    return f"cast(round(cast({x} as decimal(38,10)), {digits}) as double)"


# Sources and sinks

_KEYS = {
    "raw_orders": "order_id",
    "raw_order_items": "order_id",
    "raw_order_payments": "order_id",
    "raw_order_reviews": "review_id",
    "raw_customers": "customer_id",
    "raw_geolocation": "geolocation_zip_code_prefix",
    "raw_products": "product_id",
    "raw_category_translation": "product_category_name",
    "raw_sellers": "seller_id",
    "raw_marketing_qualified_leads": "mql_id",
    "raw_closed_deals": "mql_id",
}
SQL["src_raw_tables"] = "\nunion all\n".join(
    f"select '{name}' as table_name, count(*) as row_count, count(distinct k) as distinct_keys, "
    f"min(k) as first_key, max(k) as last_key from (select cast({key} as varchar) as k from {name})"
    for name, key in _KEYS.items()
)
SQL["src_csv_encoded"] = "select doc_id, lang, source, text from documents"
SQL["src_sql_adhoc"] = """
select order_date, cast(total_order_count as bigint) as total_order_count,
  cast(total_order_value as double) as total_order_value
from agg_daily_sales order by 3 desc, 1 limit 20
"""
SQL["src_doc_catalog"] = """
select cast(conv_id as varchar) as model_name, 'conversation' as description,
  row_number() over (partition by conv_id order by turn) - 1 as column_pos, role as column_name,
  text as column_description
from conversations
"""
SQL["sink_table_incremental"] = """
select strftime(order_purchase_datetime, '%Y-%m') as month, count(*) as row_count,
  cast(sum(order_total + if(order_id = last, 1, 0)) as double) as order_total,
  1 as folders, bool_or(order_id = last) as rewritten
from fact_orders, (select max(order_id) as last from fact_orders) group by 1
"""
SQL["sink_vector_upsert"] = """
select vec_id as doc_id, cast(label as bigint) as label,
  cast(if(label % 2 = 0, 1, 2) as bigint) as run, cast(len(embedding) as bigint) as dimensions
from embeddings
"""

# Macros

SQL["clean_datetime_string"] = """
select event_id, case event_id % 10
    when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%m-%d-%Y %H:%M:00')
    when 2 then strftime(ts, '%Y-%m-%d 00:00:00') when 3 then strftime(ts, '%m-%d-%Y %H:%M:%S')
    when 4 then strftime(ts, '%Y-%m-%d %H:00:00') when 5 then strftime(ts, '%m-%d-%Y 00:00:00')
    when 6 then strftime(ts, '%Y-%m-%dT%H:%M:%S 00:00:00')
    when 7 then strftime(ts, '%Y-%m-%-d %H:%M:%S') end as clean_text
from events
"""
SQL["standardize_to_datetime"] = """
select event_id, cast(case when event_id % 10 in (0, 3) then date_trunc('second', ts)
    when event_id % 10 = 1 then date_trunc('minute', ts)
    when event_id % 10 in (2, 5) then date_trunc('day', ts)
    when event_id % 10 = 4 then date_trunc('hour', ts)
    when event_id % 10 = 7 and day(ts) > 9 then date_trunc('second', ts) end as timestamp)
    as standard_datetime
from events
"""
SQL["classify_lead_type"] = """
select mql_id, lead_type, channel, tier from raw_closed_deals left join (values
  ('online_beginner', 'Online', 'Beginner'), ('online_small', 'Online', 'Small'),
  ('online_medium', 'Online', 'Medium'), ('online_big', 'Online', 'Big'),
  ('online_top', 'Online', 'Top'), ('offline', 'Offline', null), ('industry', null, 'Industry'),
  ('other', null, 'Other')) as t(kind, channel, tier) on kind = lead_type
"""
SQL["schema_name_for_env"] = """
select doc_id, source || coalesce(map {'en': '_dev', 'fr': '_uat'}[lang], '') as schema_name
from documents
"""

# Data quality


def _violations(model: str, column: str, value: str, condition: str, least: int = 1) -> str:
    return (
        f"select '{model}' as model, '{column}' as column_name, cast({value} as varchar) as value, "
        f"count(*) as failures from {model} where {condition} group by {value} "
        f"having count(*) >= {least}"
    )


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def _column(name: str) -> tuple[str, str]:
    model, column = name.split(".")
    return model, column


SQL["dq_not_null"] = _union(
    [
        f"select '{model}' as model, '{column}' as column_name, cast(null as varchar) as value, "
        f"count(*) - count({column}) as failures from {model}"
        for model, column in map(_column, declared.NOT_NULL)
    ]
)


def _counted(check: str, name: str, failing: str) -> str:
    model, column = _column(name)
    return (
        f"select '{model}' as model, '{check}' as \"check\", '{column}' as column_name, "
        f"count(*) as row_count, count(*) filter ({failing.format(column)}) as failures from {model}"
    )


SQL["dq_suite"] = _union(
    [_counted("not_null", name, "{} is null") for name in declared.NOT_NULL]
    + [_counted("between", name, "{} < 0") for name in declared.NOT_NEGATIVE]
    + [_counted("between", name, "{} < 1") for name in declared.AT_LEAST_ONE]
    + [_counted("between", name, "{} not between 1 and 5") for name in declared.SCORES]
    + [_counted("accepted_values", "fact_orders.on_time_delivery_flag", "{} not in (0, 1)")]
    + [_counted("in_set", "fact_closed_deals.mql_link_status", "{} not in ('linked', 'orphaned')")]
)
SQL["dq_unique"] = _union(
    [
        _violations(model, column, column, f"{column} is not null", 2)
        for model, column in map(_column, declared.UNIQUE)
    ]
    + [
        """select 'stg_order_items', 'line_key', concat(l_orderkey, '-', l_linenumber), count(*)
    from lineitem group by l_orderkey, l_linenumber having count(*) > 1"""
    ]
)


def _unrelated(line: str) -> str:
    (model, column), (parent, key) = map(_column, line.split())
    known = f"select {key} from {parent} where {key} is not null"
    return _violations(model, column, column, f"{column} not in ({known})")


SQL["dq_relationships"] = _union(
    [_unrelated(line) for line in declared.RELATED]
    + [_violations("documents", "doc_id", "doc_id", "doc_id not in (select doc_id from labels)")]
)
SQL["dq_accepted_values"] = _union(
    [_violations("fact_orders", "on_time_delivery_flag", "on_time_delivery_flag", "on_time_delivery_flag not in (0, 1)")]
    + [_violations("orders", "o_orderstatus", "o_orderstatus", "o_orderstatus not in ('O', 'F')")]
)
SQL["dq_in_set"] = """
select 'linked_deals' as model, 'mql_link_status' as column_name, mql_link_status as value,
  count(*) as failures
from fact_closed_deals where mql_link_status <> 'linked' group by mql_link_status
"""


_RANGES = {
    "{} < 0": declared.NOT_NEGATIVE,
    "{} < 1": declared.AT_LEAST_ONE,
    "{} not between 1 and 5": declared.SCORES,
}
SQL["dq_between"] = _union(
    [
        _violations(model, column, column, test.format(column))
        for test, names in _RANGES.items()
        for model, column in map(_column, names)
    ]
    + [
        _violations("lineitem", "l_linenumber", "l_linenumber", "l_linenumber not between 2 and 6"),
        _violations("lineitem", "l_partkey", "l_partkey", "l_partkey < 10"),
    ]
)
SQL["dq_schema_contract"] = """
select cast(conv_id as varchar) as model, lower(role) || '_' || turn as column_name,
  'produced, not documented' as problem
from conversations where turn = 3
union all
select distinct cast(conv_id as varchar), 'dropped_column', 'documented, not produced'
from conversations where turn = 2
"""
SQL["dq_csv_shape"] = """
select record, cast(if(source = 'src7', 2, 4) as bigint) as fields, cast(3 as bigint) as expected,
  count(*) over () as total_errors, part
from (select source, cast(doc_id % 64 as varchar) as part,
    row_number() over (partition by doc_id % 64 order by doc_id) + 1 as record
  from documents)
where source in ('src7', 'src11') order by cast(part as varchar), record limit 20
"""

# Profiling

_ORDERS = [
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "other"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "datetime"),
    ("o_orderpriority", "string", "other"),
]
_LINES = [
    *[(f"l_{c}", "bigint", "numeric") for c in ("orderkey", "partkey", "suppkey")],
    ("l_linenumber", "int", "numeric"),
    *[(f"l_{c}", "double", "numeric") for c in ("quantity", "extendedprice", "discount", "tax")],
    *[(f"l_{c}", "string", "other") for c in ("returnflag", "linestatus")],
    ("l_shipdate", "timestamp_ntz", "datetime"),
]
_EVENTS = [
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp_ntz", "datetime"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "other"),
    ("value", "double", "numeric"),
    ("props", "string", "other"),
]


def _profile(table: str, columns: list[tuple[str, str, str]]) -> str:
    return _union(
        [
            f"select {i} as position, '{c}' as column_name, '{dtype}' as dtype, '{kind}' as kind, "
            f"count(*) as row_count, count(distinct {c}) as unique_count, "
            f"count(*) - count({c}) as null_count, array_to_string(list_sort(list_distinct("
            f"list(cast({c} as varchar))))[1:5], ',') as sample_values from {table}"
            for i, (c, dtype, kind) in enumerate(columns)
        ]
    )


def _roles(profile: str) -> str:
    """Roles from a profile subquery, rule by rule."""
    return f"""
select *, not is_id and not is_datetime and (kind = 'other' or is_boolean or unique_count < 21)
    as is_categorical
from (
  select cast(position as bigint) as position, column_name, row_count, unique_count,
    kind = 'numeric' and unique_count <> 2 as is_numeric, kind = 'datetime' as is_datetime,
    kind = 'numeric' and unique_count = 2 as is_boolean, kind,
    case when contains(lower(column_name), 'id') then unique_count > 0.8 * row_count
      else kind <> 'numeric' and unique_count = row_count end as is_id,
    case when unique_count < 11 then 'low' when unique_count < 51 then 'medium' else 'high' end
      as cardinality
  from {profile})
"""


def _dataset(roles: str) -> str:
    def listed(condition: str, order: str = "position") -> str:
        return (
            f"coalesce(string_agg(column_name, ',' order by {order}) filter ({condition}), '')"
        )

    dims = "is_categorical and not is_id and cardinality <> 'high'"
    return f"""
select max(row_count) as row_count, count(*) as column_count,
  {listed("is_numeric and not is_id")} as numeric_columns,
  {listed("is_categorical and not is_id")} as categorical_columns,
  {listed("is_datetime")} as datetime_columns, {listed("is_id")} as id_columns,
  bool_or(is_datetime) as has_time_series,
  {listed(dims, "is_numeric, unique_count, position")} as primary_dimensions,
  {listed("is_numeric and not is_id")} as primary_metrics,
  (array_agg(cardinality order by is_numeric, unique_count, position) filter ({dims}))[1]
    as first_dimension_cardinality
from {roles}
"""


PARTS["orders_profile"] = _profile("orders", _ORDERS)
PARTS["orders_roles"] = _roles("orders_profile")
PARTS["orders_dataset"] = _dataset("orders_roles")
PARTS["lines_profile"] = _profile("lineitem", _LINES)
PARTS["lines_roles"] = _roles("lines_profile")
PARTS["events_profile"] = _profile("events", _EVENTS)
PARTS["events_roles"] = _roles("events_profile")
PARTS["events_dataset"] = _dataset("events_roles")

SQL["profile_columns"] = """
select position::bigint as position, column_name, dtype, kind, row_count, unique_count, null_count,
  round(100.0 * null_count / row_count, 4)::double as null_percentage, sample_values
from orders_profile
"""
_LINE_NUMBERS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
SQL["profile_numeric"] = _union(
    [
        f"select '{c}' as column_name, {_d(f'avg({c})', 4)} as mean, "
        f"{_d(f'quantile_cont(cast({c} as double), 0.5)', 4)} as median, "
        f"{_d(f'stddev_samp({c})', 4)} as std, cast(min({c}) as double) as min_val, "
        f"cast(max({c}) as double) as max_val from lineitem"
        for c in _LINE_NUMBERS
    ]
)
SQL["profile_sketches"] = _union(
    [
        f"select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, "
        + (
            f"{_d(f'avg({c})', 4)} as mean, {_d(f'stddev_samp({c})', 4)} as std, "
            f"cast(min({c}) as double) as min_val, cast(max({c}) as double) as max_val, "
            if c in _LINE_NUMBERS
            else "null as mean, null as std, null as min_val, null as max_val, "
        )
        + "true as distinct_ok, true as median_ok, 1 as new_parts from lineitem"
        for c in [*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
    ]
)
SQL["profile_top_values"] = _union(
    [
        f"""select '{c}' as column_name, rank, value, occurrences from (
  select cast({c} as varchar) as value, count(*) as occurrences,
    row_number() over (order by count(*) desc, cast({c} as varchar)) as rank
  from lineitem where {c} is not null group by {c}) where rank <= 10"""
        for c, _, _ in _LINES
    ]
)
SQL["profile_top_values"] = f"""
select * from ({SQL["profile_top_values"]})
where column_name in (select column_name from lines_roles where is_categorical)
"""
SQL["profile_roles"] = "select * exclude (kind) from events_roles"
SQL["profile_dataset"] = "select * from events_dataset"
SQL["insight_summary"] = """
select concat_ws(chr(10) || chr(10),
  format('**Dataset Overview**: {:,} rows, {} columns', d.row_count, d.column_count),
  '**Key Metrics**: ' || array_to_string(string_split(primary_metrics, ',')[1:3], ', '),
  format('**user_id**: Avg: {:,.2f}, Range: {:,.2f} - {:,.2f}', mean, lo, hi),
  '**Dimensions**: ' || array_to_string(string_split(primary_dimensions, ',')[1:3], ', '),
  '**Time Period**: Data includes time-series information',
  '**Analysis Type**: Trend analysis over time') as summary
from events_dataset d, (select avg(user_id) as mean, min(user_id)::double as lo,
  max(user_id)::double as hi from events)
"""

# Chart data

SQL["chart_recommend"] = """
select row_number() over (order by place) as rank, chart_type, x, y, color, title
from (
  select unnest([
    {place: 1, chart_type: 'line', x: t1, y: m1, color: d1, title: m1 || ' Over Time'},
    {place: 3, chart_type: 'bar', x: m1, y: d1, color: null, title: 'Top ' || d1 || ' by ' || m1},
    {place: 4, chart_type: 'grouped_bar', x: d1, y: m1, color: d2,
      title: m1 || ' by ' || d1 || ' and ' || d2},
    {place: 5, chart_type: 'histogram', x: m1, y: null, color: null, title: 'Distribution of ' || m1},
    {place: 6, chart_type: 'pie', x: d1, y: m1, color: null, title: m1 || ' Distribution by ' || d1},
    {place: 7, chart_type: 'scatter', x: m1, y: m2, color: d1, title: m2 || ' vs ' || m1}
  ], recursive := true)
  from (select string_split(primary_metrics, ',')[1] as m1, string_split(primary_metrics, ',')[2] as m2,
      string_split(primary_dimensions, ',')[1] as d1, string_split(primary_dimensions, ',')[2] as d2,
      string_split(datetime_columns, ',')[1] as t1
    from orders_dataset))
where title is not null order by place limit 4
"""
SQL["chart_fallback"] = """
select cast(1 as bigint) as rank, if(dim = '', 'line', 'bar') as chart_type, if(dim = '', time, dim) as x,
  metric as y, cast(null as varchar) as color, if(dim = '', metric || ' Over Time', metric || ' by ' || dim) as title
from (select string_split(primary_dimensions, ',')[1] as dim, string_split(datetime_columns, ',')[1] as time,
    string_split(primary_metrics, ',')[1] as metric
  from events_dataset)
"""
SQL["chart_top10"] = """
select product_id, cast(sum(item_price) as double) as item_price from fact_order_lines
group by product_id order by sum(item_price) desc, product_id limit 10
"""
SQL["chart_pie_top8"] = """
select seller_id, cast(sum(item_price) as double) as item_price from fact_order_lines
where seller_id is not null group by seller_id order by sum(item_price) desc, seller_id limit 8
"""
SQL["chart_group_agg"] = f"""
select rule, order_status, cast(review_count as bigint) as review_count, {_d("y", 4)} as y
from (
  select order_status, review_count, unnest(['sum', 'mean', 'count']) as rule,
    unnest([cast(sum(order_total) as double), avg(order_item_count), cast(count(*) as double)]) as y
  from fact_orders where order_status is not null and review_count is not null group by 1, 2)
"""
SQL["chart_time_series"] = "select * from events order by ts, event_id"
SQL["trend_pct_change"] = f"""
select first_value, last_value, {_d("pct", 4)} as pct_change, if(pct > 0, 'up', 'down') as direction
from (
  select *, (last_value - first_value) / nullif(first_value, 0) * 100 as pct
  from (select (select value from events order by ts, event_id limit 1) as first_value,
    (select value from events order by ts desc, event_id desc limit 1) as last_value))
"""
SQL["chart_histogram"] = f"""
select cast(bin as bigint) as bin, {_d("lo + (hi - lo) / 20 * bin", 4)} as bin_start,
  {_d("lo + (hi - lo) / 20 * (bin + 1)", 4)} as bin_end, count(*) as row_count,
  {_d("any_value(mean)", 4)} as mean
from (
  select least(floor((l_quantity - lo) * 20 / (hi - lo)), 19) as bin, lo, hi, mean
  from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi, avg(l_quantity) as mean
    from lineitem))
group by bin, lo, hi
"""
_PARTS = {"minimum": 0, "lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75, "maximum": 1}
SQL["chart_box"] = _union(
    [
        f"select '{c}' as column_name, "
        + ", ".join(f"{_d(f'quantile_cont({c}, {p})', 4)} as {name}" for name, p in _PARTS.items())
        + " from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ]
)
SQL["correlation_matrix"] = _union(
    [
        f"select '{a}' as column_x, '{b}' as column_y, {_d(f'corr({a}, {b})', 6)} as correlation "
        "from lineitem"
        for a in _LINE_NUMBERS
        for b in _LINE_NUMBERS
    ]
)
SQL["chart_time_series_bounded"] = """
with points as (
  select event_id, ts, value, epoch_us(ts)::hugeint as t from events
  where ts is not null and value is not null and not isnan(value)
),
placed as (
  select *, ((t - (select min(t) from points)) * 200
    // (select max(t) - min(t) + 1 from points))::bigint as pixel from points
),
ranked as (
  select *,
    row_number() over (partition by pixel order by ts, event_id, value) as a,
    row_number() over (partition by pixel order by ts desc, event_id desc, value desc) as b,
    row_number() over (partition by pixel order by value, ts, event_id) as c,
    row_number() over (partition by pixel order by value desc, ts, event_id desc) as d
  from placed
)
select pixel, ts, value, event_id from ranked where 1 in (a, b, c, d)
"""
SQL["chart_scatter_sample"] = """
select l_quantity, l_extendedprice, l_returnflag from lineitem
qualify row_number() over (partition by l_returnflag order by
  md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
  l_quantity, l_extendedprice) <= 100
"""
SQL["chart_scatter"] = "select l_quantity, l_extendedprice, l_returnflag from lineitem"

# Texts and vectors

SQL["doc_build"] = """
select cast(conv_id as varchar) as model_name, rtrim('Model: ' || conv_id
  || chr(10) || 'Description: conversation' || chr(10) || chr(10) || 'Columns:' || chr(10)
  || string_agg('- ' || role || ': ' || text, chr(10) order by turn), ' ' || chr(10)) as text
from conversations group by conv_id
"""
SQL["doc_truncate"] = """
select doc_id, if(length(text) > 2000, text[1:1990] || '... [truncated]', text) as text from documents
"""
SQL["doc_id_md5"] = "select doc_id, md5(source || '::' || doc_id) as uid from documents"
SQL["doc_incremental_dedupe"] = """
select distinct doc_id, source, n_chars from documents where doc_id not in (select doc_id from labels)
"""
SQL["embed_stats"] = """
select count(*) filter (l.doc_id is null) as embedded, count(*) filter (l.toxic = 1) as errors,
  count(distinct d.source) as files
from documents d left join labels l on l.doc_id = d.doc_id
"""
PARTS["nearest"] = """
select query_id, rank, doc_id from (
  select a.vec_id as query_id, b.vec_id as doc_id, row_number() over (partition by a.vec_id
    order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank
  from embeddings a, embeddings b)
where rank <= 3
"""
SQL["vector_topk"] = "select * from nearest"
SQL["vector_topk_indexed"] = SQL["vector_topk"]
SQL["context_assemble"] = """
select query_id,
  string_agg('Model: ' || source || chr(10) || text, chr(10) || chr(10) order by rank) as context
from nearest n join documents d on d.doc_id = n.doc_id group by query_id
"""
SQL["classify_sql_request"] = """
select conv_id, turn, regexp_matches(lower(text), 'sql|query|select|from') as is_sql_request
from conversations
"""
_INTENTS = {
    "trend": "trend|over time|time series|historical|change|growth|decline|daily|weekly|monthly|"
    "yearly|year|month|day|progression|evolution|development",
    "comparison": "compare|vs|versus|difference|between|by category|by type|by group|across|"
    "which.*better|which.*more|which.*less",
    "distribution": "distribution|spread|range|frequency|histogram|how many|count of|number of|"
    "breakdown|split",
    "ranking": "top|bottom|best|worst|highest|lowest|rank|ranking|order by|most|least",
    "composition": "composition|makeup|proportion|percentage|share|part of|portion|segment|"
    "contribute|contribution",
    "relationship": "relationship|correlation|connection|related|impact|affect|influence|depend|"
    "depends on",
    "aggregation": "total|sum|average|mean|count|aggregate|revenue|sales|profit|value",
}
_TESTS = ", ".join(
    f"if(regexp_matches(lower(text), '(^|[^\\pL\\pN_])({words})($|[^\\pL\\pN_])'), '{intent}', null)"
    for intent, words in _INTENTS.items()
)
SQL["classify_intents"] = f"""
select conv_id, turn, array_to_string(found, ',') as intents, found[1] as primary_intent
from (
  select conv_id, turn, if(len(hits) = 0, ['unknown'], hits) as found
  from (select conv_id, turn, list_filter([{_TESTS}], lambda x: x is not null) as hits
    from conversations))
"""
SQL["extract_fenced_sql"] = """
select conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as sql_text from conversations
"""
# The signs and letters of Latin-1 in their order, without the soft hyphen. A quote
# is doubled.
_LATIN_LINE = (
    " !C/PS$?Y=|SS\"(c)a<<!(r)-deg+-23''uP*,1o>>1/41/23/4?"
    "AAAAAAAECEEEEIIIIDNOOOOOxOUUUUYThssaaaaaaaeceeeeiiiidnooooo/ouuuuythy"
)
SQL["text_ascii_clean"] = f"""
select doc_id, lang, 'e ' || source as source, '{_LATIN_LINE} ' ||
  regexp_replace(strip_accents(replace(text, 'ß', 'ss')), '[^ -~]', '', 'g') as text
from documents
"""


def analysis_statements() -> dict[str, str]:
    built = {name: statement(sql.strip()) for name, sql in SQL.items()}
    built["sink_csv"] = typed("agg_daily_sales", *OUTPUT["agg_daily_sales"])
    built["maintain_product_daily"] = typed(
        "fact_product_daily_metrics", *OUTPUT["fact_product_daily_metrics"]
    )
    built["maintain_daily_sales"] = typed("agg_daily_sales", *OUTPUT["agg_daily_sales"])
    built["sink_table"] = typed("agg_customer_performance", *OUTPUT["agg_customer_performance"])
    return built

