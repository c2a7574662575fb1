import csv
import random

import pytest
from pyspark.sql import functions as F

from martwright.operators import documents
from martwright.sources import docs, files, tables
from martwright.sources.sample import SampleTables

from conftest import SAMPLE


def python_shape(path):
    with open(path, encoding="utf-8", newline=None) as handle:
        reader = csv.reader(handle)
        expected = len(next(reader))
        return [(i, len(r)) for i, r in enumerate(reader, 2) if len(r) != expected], expected


def odd_csv(seed, lines):
    """Records with quoted commas, quotes and line breaks, stray quotes, and blank lines."""
    rng = random.Random(seed)
    plain = ["x", "", "12", 'in"side', "é ç", "a b"]
    quoted = ['"a,b"', '"say ""hi"""', '"two\nlines"', '"\n\n"', '""', '"tail"end', '"c,\n""d"",\ne"', '"",']
    out = ["a,b,c"]
    for _ in range(lines):
        kind = rng.random()
        if kind < 0.05:
            out.append("")
            continue
        width = 3 if kind < 0.8 else rng.choice([1, 2, 4, 5])
        out.append(",".join(rng.choice(plain if rng.random() < 0.6 else quoted) for _ in range(width)))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("split", [60, 1000, 10**8])
def test_csv_records_equal_the_csv_module(spark, tmp_path, split):
    path = tmp_path / "odd.csv"
    path.write_text(odd_csv(split, 250), encoding="utf-8")
    wrong, expected = python_shape(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = files.csv_records(spark, str(path))
        got = {r.record: r.fields for r in records.collect()}
        report = files.csv_shape(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with open(path, encoding="utf-8", newline=None) as handle:
        want = {i: len(r) for i, r in enumerate(csv.reader(handle), 1)}
    assert got == want
    assert [(r.record, r.fields) for r in report] == wrong[:20]
    assert {(r.expected, r.total_errors) for r in report} == {(expected, len(wrong))}


def test_csv_shape_without_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n,y"\n')
    (tmp_path / "b.csv").write_text("a,b,c\n1,2,3\n")
    assert files.csv_shape(spark, str(tmp_path)).count() == 0


def test_encoding_is_found_per_file(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes('id,t\n1,"São\nJosé"\n'.encode())
    (tmp_path / "l.csv").write_bytes("id,t\n2,Ação\n".encode("latin-1"))
    read = files.read_csv_encoded(spark, str(tmp_path), "id int, t string")
    assert sorted(tuple(r) for r in read.collect()) == [(1, "São\nJosé"), (2, "Ação")]
    only = files.read_csv_encoded(spark, str(tmp_path / "l.csv"), "id int, t string")
    assert only.first().t == "Ação"
    fine = files.read_csv_encoded(spark, str(tmp_path / "u.csv"), "id int, t string")
    assert fine.first().t == "São\nJosé"


def test_sink_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"uote, and\nbreak'), (2, "é")], "id int, t string")
    path = files.sink_csv(df, str(tmp_path / "out"))
    back = files.read_csv_encoded(spark, path, df.schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_raw_tables_read_with_fixed_schema(spark, tmp_path):
    (tmp_path / "raw_orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "007,c,delivered,2018-01-01 10:00:00,,,,2018-02-01 00:00:00\n"
    )
    row = tables.RawTables(spark, str(tmp_path)).get("raw_orders").first()
    assert row.order_id == "007" and row.order_approved_at is None
    assert str(row.order_purchase_timestamp) == "2018-01-01 10:00:00"


def test_doc_catalog(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yml").write_text(
        "version: 2\nmodels:\n  - name: m1\n    description: first\n    columns:\n"
        "      - name: c1\n        description: one\n      - name: c2\n      - 7\n"
        "  - name: m2\n  - description: nameless\n"
    )
    (tmp_path / "deep" / "b.yaml").write_text("models:\n  - name: m3\n    columns: [{name: x, description: 'é'}]\n")
    (tmp_path / "bad.yml").write_text("models: [unclosed\n")
    (tmp_path / "list.yml").write_text("- a\n")
    (tmp_path / "note.txt").write_text("models: [{name: no}]")
    got = docs.read_doc_catalog(spark, str(tmp_path)).drop("file_path")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [
        ("m1", "first", 0, "c1", "one"),
        ("m1", "first", 1, "c2", ""),
        ("m2", "", 0, None, None),
        ("m3", "", 0, "x", "é"),
    ]
    comments = docs.column_comments(docs.read_doc_catalog(spark, str(tmp_path)))
    assert comments == {"m1": {"c1": "one", "c2": ""}, "m3": {"x": "é"}}


def test_sink_csv_bounds_its_files(spark, tmp_path):
    df = spark.range(25, numPartitions=1).withColumn("text", F.lit('two\nlines, "quoted"'))
    path = files.sink_csv(df, str(tmp_path / "out"), max_records=10)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3
    back = files.read_csv_encoded(spark, path, "id bigint, text string")
    assert back.exceptAll(df).count() == 0 and back.count() == 25


def test_vector_upsert_keeps_what_is_stored(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "doc_id string, text string, embedding array<float>"
    first = spark.createDataFrame([("a", "old", [1.0]), ("b", "b", [2.0]), ("b", "b2", [3.0])], schema)
    second = spark.createDataFrame([("a", "new", [9.0]), ("c", "c", [4.0])], schema)
    assert docs.vector_upsert(first, store).count() == 2
    got = {r.doc_id: r.text for r in docs.vector_upsert(second, store).collect()}
    assert got == {"a": "old", "b": "b", "c": "c"}
    assert documents.incremental_dedupe(second, spark.read.parquet(store)).count() == 0


def test_run_sql(spark):
    spark.range(50).select("id", F.col("id").alias("credit_limit")).createOrReplaceTempView("numbers")
    assert tables.run_sql(spark, " select credit_limit from numbers; ").count() == 20
    assert tables.run_sql(spark, "select id from numbers\nLIMIT 30").count() == 30
    assert tables.run_sql(spark, "with n as (select * from numbers) select * from n").count() == 20
    for text in (
        "select 'no limit here' as t, id from numbers",
        "select id from numbers -- limit 5",
        "select id from numbers where id > (select min(id) from numbers limit 1)",
    ):
        assert tables.run_sql(spark, text).count() == 20, text
    limited = "with n as (select * from numbers) select * from n order by id limit 33"
    assert tables.run_sql(spark, limited).count() == 33
    for text in (
        "drop view numbers",
        "insert into numbers values (1)",
        "",
        "with a as (select 7 as id) insert into numbers select * from a",
        "select 1) as a; drop view numbers; select * from (select 1",
        "from numbers insert into numbers select id",
    ):
        with pytest.raises(ValueError, match="SELECT"):
            tables.run_sql(spark, text)


@pytest.fixture(scope="module")
def built(spark):
    raw = SampleTables(spark, SAMPLE).raw
    names = [
        "stg_orders",
        "stg_order_items",
        "stg_order_payments",
        "stg_reviews",
        "stg_customers",
        "stg_geolocation",
        "dim_customers",
        "fact_orders",
        "fact_order_lines",
        "agg_daily_sales",
        "agg_seller_performance",
    ]
    comments = {"agg_daily_sales": {"order_date": "day of purchase"}}
    return tables.build_warehouse(spark, raw, "uat", names, comments=comments, buckets=4)


def test_build_warehouse_stores_by_layer(spark, built):
    assert spark.catalog.tableExists("intermediate_uat.fact_orders")
    assert spark.catalog.tableExists("analytics_uat_agg_seller_performance")
    field = spark.table("intermediate_uat.agg_daily_sales").schema["order_date"]
    assert field.metadata["comment"] == "day of purchase"


def test_bucketed_facts_join_without_a_shuffle(spark, built, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = built.get("fact_order_lines"), built.get("fact_orders")
        lines.join(orders.select("order_id", "order_total"), "order_id").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_tables_by_month_read_the_months_they_need(spark):
    days = spark.range(400).selectExpr("id", "date_add(date'2018-01-01', cast(id as int)) as day")
    stored = tables.sink_table(days, "by_month", "months_uat", month_of="day")
    assert stored.columns == ["id", "day", "day_month"] and stored.count() == 400
    assert stored.where("day_month = '2018-03'").count() == 31
    with pytest.raises(ValueError, match="buckets"):
        tables.sink_table(days, "x", "months_uat", bucket_by="id")
    with pytest.raises(ValueError, match="either"):
        tables.sink_table(days, "x", "months_uat", bucket_by="id", buckets=2, month_of="day")


def test_facts_without_buckets_are_kept_by_month(spark):
    raw = SampleTables(spark, SAMPLE).raw
    built = tables.build_warehouse(spark, raw, "dev", ["stg_order_payments", "fact_payments"])
    assert "payment_date_month" in spark.table("intermediate_dev.fact_payments").columns
    assert "payment_date_month" not in built.get("fact_payments").columns


def _geolocation(tmp_path, header, *lines):
    (tmp_path / "raw_geolocation.csv").write_text("\n".join([header, *lines]) + "\n")


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    _geolocation(
        tmp_path,
        "geolocation_lat,geolocation_state,geolocation_city,geolocation_zip_code_prefix",
        "-23.5,sp,são paulo,1037",
    )
    row = tables.RawTables(spark, str(tmp_path)).get("raw_geolocation").first()
    assert tuple(row) == (1037, "são paulo", "sp")


def test_a_missing_csv_column_is_an_error(spark, tmp_path):
    _geolocation(tmp_path, "geolocation_state,geolocation_city", "sp,x")
    with pytest.raises(ValueError, match="geolocation_zip_code_prefix"):
        tables.RawTables(spark, str(tmp_path)).get("raw_geolocation")


def test_bad_csv_records_fail_or_are_set_aside(spark, tmp_path):
    header = "geolocation_zip_code_prefix,geolocation_city,geolocation_state"
    _geolocation(tmp_path, header, "1,a,x", "abc,b,y", "3,c", "4,d,z,w", ",e,v")
    with pytest.raises(Exception, match="raw_geolocation"):
        tables.RawTables(spark, str(tmp_path)).get("raw_geolocation").select(
            "geolocation_city"
        ).collect()
    apart = tables.RawTables(spark, str(tmp_path), set_aside=True)
    assert sorted(map(tuple, apart.get("raw_geolocation").collect()), key=repr) == [
        (1, "a", "x"), (None, "e", "v"),
    ]
    problems = sorted(r["problem"] for r in apart.bad_records("raw_geolocation").collect())
    assert problems == [
        "fields do not match the header",
        "fields do not match the header",
        "geolocation_zip_code_prefix is not int: abc",
    ]


def test_csv_without_free_text_is_read_in_splits(spark, tmp_path):
    header = "geolocation_zip_code_prefix,geolocation_city,geolocation_state"
    _geolocation(tmp_path, header, *(f"{i},city{i},sp" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        zips = tables.RawTables(spark, str(tmp_path)).get("raw_geolocation")
        assert zips.rdd.getNumPartitions() > 1 and zips.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_free_text_may_run_over_lines(spark, tmp_path):
    (tmp_path / "raw_order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r,o,5,,"two\nlines, ""quoted""",2018-01-01 00:00:00,2018-01-02 00:00:00\n'
    )
    row = tables.RawTables(spark, str(tmp_path)).get("raw_order_reviews").first()
    assert row.review_comment_message == 'two\nlines, "quoted"' and row.review_score == 5


def test_clean_csv_of_either_encoding(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "latin-1")):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.csv").write_bytes(f"n,t,u\n1,né {name},\"º, x\"\n".encode(encoding))
    schema = "n int, t string, u string"
    target = files.clean_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema)
    rows = spark.read.schema(schema).option("header", True).csv(target).collect()
    assert sorted(map(tuple, rows)) == [(1, "ne a", "o, x"), (1, "ne b", "o, x")]


def test_long_conversations_and_many_models_share_few_files(spark, tmp_path):
    from martwright.plans.queries import all_queries

    rows = [(1, t, "user", f"turn {t}") for t in range(100)]
    rows += [(c, 0, "user", "x") for c in range(2, 600)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    found = all_queries()["src_doc_catalog"](spark, str(tmp_path))
    assert found.where("model_name = '1'").count() == 100
    assert found.count() == 698


def test_whole_texts_enter_the_context(spark, tmp_path):
    from martwright.plans.queries import all_queries

    spark.createDataFrame(
        [(1, "w" * 20_000, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(1, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    row = all_queries()["context_assemble"](spark, str(tmp_path)).first()
    assert row["context"] == "Model: s\n" + "w" * 20_000
