from martwright.operators import quality
from martwright.plans import checks
from martwright.plans.catalog import MODELS


def test_not_null_lists_all_columns(spark, rows):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert rows(quality.not_null(df, ["a", "b"])) == [("a", None, 1), ("b", None, 2)]


def test_unique_ignores_null(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "y"), (None, "z")], "a int, b string")
    assert rows(quality.unique(df, ["a", "b"])) == [("a", "1", 2), ("b", "y", 2)]


def test_relationships(spark, rows):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert rows(quality.relationships(child, "k", parent, "id")) == [("k", "2", 2)]


def test_values_and_ranges(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (5,), (5,), (None,)], "v int")
    assert rows(quality.accepted_values(df, "v", [0, 1])) == [("v", "5", 2)]
    assert rows(quality.in_set(df, "v", [0, 1, 5])) == []
    assert rows(quality.between(df, {"v": (1, 4)})) == [("v", "0", 1), ("v", "5", 2)]
    assert rows(quality.between(df, {"v": (None, 4)})) == [("v", "5", 2)]
    assert rows(quality.between(df, {"v": (0, 5)})) == []


def test_schema_contract(spark, rows):
    documented = spark.createDataFrame(
        [("m", "order_id"), ("m", "unavaialble_order_count")], "model string, column_name string"
    )
    frame = spark.createDataFrame([], "Order_ID string, unavailable_order_count int")
    got = rows(quality.schema_contract(documented, quality.columns_as_rows("m", frame)))
    assert got == [
        ("m", "unavaialble_order_count", "documented, not produced"),
        ("m", "unavailable_order_count", "produced, not documented"),
    ]


def test_all_declared_checks_are_there():
    assert checks.CHECK_COUNT == 124
    assert sum(len(c.split()) for c in checks.NOT_NULL.values()) == 67
    named = set(checks.NOT_NULL) | set(checks.UNIQUE) | set(checks.BETWEEN)
    assert named <= set(MODELS)
