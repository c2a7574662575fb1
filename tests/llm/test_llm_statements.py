"""The registered queries: their names, and those that SQL can express against their SQL."""

import pytest

import check
from __spark_entry__ import oracle_sql, queries
from martwright.llm.queries import QUERIES
from martwright.llm.statements import STATEMENTS

SAMPLE = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(STATEMENTS) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_statement(spark, name):
    outcome = check.compare(spark, check.connect(SAMPLE), SAMPLE, name)
    assert outcome.startswith("ok"), outcome
