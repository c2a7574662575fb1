"""Every registered query against its SQL statement on the smallest sample."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from martwright.plans.catalog import MODELS
from martwright.plans.queries import all_queries
from oracle.statements import all_statements

from conftest import SAMPLE

# The other keys of the operator inventory.
OPERATORS = """
src_raw_tables src_csv_encoded src_doc_catalog sink_table sink_csv sink_vector_upsert src_sql_adhoc
sink_table_incremental maintain_product_daily maintain_daily_sales
standardize_to_datetime clean_datetime_string classify_lead_type schema_name_for_env
dq_not_null dq_unique dq_relationships dq_accepted_values dq_between dq_in_set dq_schema_contract
dq_csv_shape dq_suite profile_sketches profile_columns profile_numeric profile_top_values profile_roles profile_dataset
insight_summary chart_top10 chart_group_agg chart_pie_top8 chart_time_series trend_pct_change
chart_histogram chart_box correlation_matrix chart_scatter chart_time_series_bounded
chart_scatter_sample chart_recommend chart_fallback
doc_build doc_truncate doc_id_md5 doc_incremental_dedupe embed_stats vector_topk vector_topk_indexed
context_assemble
classify_sql_request classify_intents extract_fenced_sql text_ascii_clean
""".split()


def test_inventory_is_complete():
    assert set(all_queries()) == set(MODELS) | set(OPERATORS)
    assert set(all_statements()) == set(all_queries())
    assert set(all_queries()) <= set(queries()) and set(all_statements()) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "order_date" and df.count() > 0


@pytest.fixture(scope="module")
def database():
    return check.connect(SAMPLE)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_statement(spark, database, name):
    outcome = check.compare(spark, database, SAMPLE, name)
    assert outcome.startswith("ok"), outcome


def test_comparison_notices_a_difference(spark, database, monkeypatch):
    statements = oracle_sql()
    statements["agg_daily_sales"] = statements["agg_daily_sales"].replace("'Canceled'", "'Shipped'")
    monkeypatch.setattr(check, "oracle_sql", lambda: statements)
    assert check.compare(spark, database, SAMPLE, "agg_daily_sales").startswith("FAIL")
