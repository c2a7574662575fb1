"""Committed versions, month-wise materialization, and maintenance by affected keys."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from martwright.plans import core, maintain
from martwright.plans.queries import Inputs
from martwright.sources import docs, tables
from martwright.sources.commits import CommitLog

SAMPLE = "/root/testdata/sf0.001"


# Commit log


def test_a_version_is_committed_once(spark, tmp_path):
    log, other = (CommitLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert log.read() == (0, {}) and log.versions() == []
    assert log.commit(1, {"a": [1]})
    assert not other.commit(1, {"a": [2]})
    assert other.read() == (1, {"a": [1]})
    assert other.commit(2, {"a": "é"}) and log.read() == (2, {"a": "é"})
    assert log.read(1) == (1, {"a": [1]})
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json") == [
        "000000000001.json", "000000000002.json",
    ]


def test_concurrent_writers_lose_no_update(spark, tmp_path):
    def add(name):
        log = CommitLog(spark, f"{tmp_path}/log")
        for i in range(5):
            log.update(lambda state, i=i: {"all": [*state.get("all", []), f"{name}{i}"]})

    writers = [threading.Thread(target=add, args=(n,)) for n in "abcd"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    version, state = CommitLog(spark, f"{tmp_path}/log").read()
    assert version == 20 and sorted(state["all"]) == sorted(f"{n}{i}" for n in "abcd" for i in range(5))


def test_an_overtaken_writer_gives_up_in_the_end(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"{tmp_path}/log")
    monkeypatch.setattr(log, "commit", lambda *_: False)
    with pytest.raises(RuntimeError, match="overtaken"):
        log.update(lambda state: {"x": 1}, attempts=3)


# Vector store


def _documents(spark, ids, text):
    return spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_two_writers_store_no_document_twice(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    docs.vector_upsert(_documents(spark, [1], "first"), store)
    commit, raced = CommitLog.commit, []

    def overtaken(self, version, state):
        # Just before this writer commits, another one stores overlapping documents.
        if not raced:
            raced.append(version)
            docs.vector_upsert(_documents(spark, [2, 3], "other"), store)
        return commit(self, version, state)

    monkeypatch.setattr(CommitLog, "commit", overtaken)
    found = docs.vector_upsert(_documents(spark, [1, 3, 4], "mine"), store)
    assert _texts(found) == {1: "first", 2: "other", 3: "other", 4: "mine"}
    assert found.count() == 4


def test_a_failed_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    docs.vector_upsert(_documents(spark, [1], "first"), store)

    def fails(self, version, state):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "commit", fails)
        with pytest.raises(OSError):
            docs.vector_upsert(_documents(spark, [2], "half"), store)
    assert _texts(docs.read_store(spark, store)) == {1: "first"}
    assert _texts(docs.vector_upsert(_documents(spark, [2], "whole"), store)) == {1: "first", 2: "whole"}


def test_versions_stay_readable_and_parts_are_compacted(spark, tmp_path):
    store = str(tmp_path / "store")
    assert docs.read_store(spark, store) is None
    for i in range(3):
        docs.vector_upsert(_documents(spark, [i], f"run {i}"), store)
    docs.vector_upsert(_documents(spark, [0, 1], "again"), store)  # nothing new: no version
    log = CommitLog(spark, f"{store}/_log")
    assert log.versions() == [1, 2, 3]
    assert _texts(docs.compact(spark, store, 1)) == {i: f"run {i}" for i in range(3)}
    assert len(log.read()[1]["parts"]) == 1
    assert _texts(docs.read_store(spark, store, 2)) == {0: "run 0", 1: "run 1"}
    assert _texts(docs.vector_upsert(_documents(spark, [9], "late"), store))[9] == "late"


def test_documents_with_another_column(spark, tmp_path):
    store = str(tmp_path / "store")
    docs.vector_upsert(_documents(spark, [1], "a"), store)
    wider = _documents(spark, [1, 2], "b").withColumn("lang", F.lit("en"))
    found = docs.vector_upsert(wider, store)
    assert sorted(map(tuple, found.collect())) == [(1, "a", None), (2, "b", "en")]


def test_an_empty_first_batch_keeps_its_columns(spark, tmp_path):
    store = str(tmp_path / "store")
    assert docs.vector_upsert(_documents(spark, [], ""), store).columns == ["doc_id", "text"]
    assert docs.vector_upsert(_documents(spark, [5], "x"), store).count() == 1


# Tables by month


def _days(spark, rows):
    return spark.createDataFrame(
        [(i, None if d is None else datetime.datetime(2018, d, 3), v) for i, d, v in rows],
        "id int, at timestamp, value string",
    )


def _folders(spark, path):
    table = tables.read_months(spark, path, with_folder=True)
    return {
        (None if r.at is None else r.at.month): r._folder
        for r in table.select("at", "_folder").distinct().collect()
    }


def test_only_changed_months_are_written(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, None, "e")]
    assert rows(tables.sink_months(_days(spark, first), path, "at")) == rows(_days(spark, first))
    before = _folders(spark, path)
    # The order of the rows does not count.
    tables.sink_months(_days(spark, first[::-1]).repartition(3), path, "at")
    assert CommitLog(spark, f"{path}/_log").versions() == [1]
    # One changed row, one removed month, one new month, one more row without a time.
    second = [(1, 1, "a"), (2, 1, "B"), (3, 2, "c"), (6, 5, "f"), (5, None, "e"), (7, None, "g")]
    assert rows(tables.sink_months(_days(spark, second), path, "at")) == rows(_days(spark, second))
    after = _folders(spark, path)
    assert after[2] == before[2] and set(after) == {1, 2, 5, None}
    assert after[1] == after[5] == after[None] != before[1]
    assert rows(tables.read_months(spark, path, 1)) == rows(_days(spark, first))


def test_repeated_rows_and_new_columns(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    twice = [(1, 1, "a"), (1, 1, "a"), (2, 2, None)]
    tables.sink_months(_days(spark, twice), path, "at")
    assert rows(tables.sink_months(_days(spark, twice[1:]), path, "at")) == rows(_days(spark, twice[1:]))
    wider = _days(spark, twice).withColumn("tags", F.create_map(F.lit("k"), F.col("value")))
    assert rows(tables.sink_months(wider, path, "at")) == rows(wider)
    assert tables.sink_months(wider.limit(0), path, "at").count() == 0
    with pytest.raises(ValueError, match="no committed table"):
        tables.read_months(spark, str(tmp_path / "none"))


def test_a_reader_of_an_older_version_is_not_disturbed(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = tables.sink_months(_days(spark, [(1, 1, "a"), (2, 2, "b")]), path, "at")
    tables.sink_months(_days(spark, [(1, 1, "z")]), path, "at")
    assert rows(old) == rows(_days(spark, [(1, 1, "a"), (2, 2, "b")]))


# Maintenance


def test_changed_keys(spark):
    kind = "key int, value string"
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (5, "x"), (6, "p"), (6, "q")], kind)
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d"), (6, "q"), (6, "p"), (None, "n")], kind)
    found = {r.key for r in maintain.changed_keys(old, new, "key").collect()}
    assert found == {1, 2, 4, 5, None}


@pytest.fixture(scope="module")
def facts(spark):
    inputs = Inputs(spark, SAMPLE)
    orders = inputs.model("fact_orders").where("order_id < 400").checkpoint()
    lines = inputs.model("fact_order_lines").where("order_id < 400").checkpoint()
    return orders, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_equals_rebuilt(spark, facts, rows, seed):
    """Random insertions, removals and changes of orders and lines."""
    orders, lines = facts
    rng = random.Random(seed)
    ids = [r.order_id for r in orders.select("order_id").collect()]
    gone, new, dated, priced, lost = (set(rng.sample(ids, 12)) for _ in range(5))
    key = F.col("order_id")

    def among(chosen):
        return key.isin(sorted(chosen))

    later = F.col("order_purchase_datetime") + F.expr("interval 40 days")
    after_orders = (
        orders.where(~among(gone))
        .withColumn("order_purchase_datetime", F.when(among(dated), later).otherwise(F.col("order_purchase_datetime")))
        .withColumn("order_status", F.when(among(lost), "Canceled").otherwise(F.col("order_status")))
    )
    after_lines = lines.where(~among(gone)).withColumn(
        "item_price", F.when(among(priced), F.col("item_price") * 2).otherwise(F.col("item_price"))
    )
    before_orders, before_lines = orders.where(~among(new)), lines.where(~among(new))
    at = "2018-12-31 00:00:00"
    wanted = core.fact_product_daily_metrics(after_lines, after_orders, as_of=at)
    stored = core.fact_product_daily_metrics(before_lines, before_orders, as_of=at).checkpoint()
    got = maintain.product_daily_metrics(
        stored, before_lines, before_orders, after_lines, after_orders, as_of=at
    )
    assert rows(got) == rows(wanted.select(*got.columns))
    sales = core.agg_daily_sales(before_orders).checkpoint()
    maintained = maintain.daily_sales(sales, before_orders, after_orders)
    assert rows(maintained) == rows(core.agg_daily_sales(after_orders).select(*maintained.columns))


def test_untouched_rows_are_kept_as_stored(spark, facts):
    """A change set given by the caller is taken as it is; other keys are not aggregated again."""
    orders, lines = facts
    at = "2018-12-31 00:00:00"
    stored = core.fact_product_daily_metrics(lines, orders, as_of=at).checkpoint()
    one = orders.select("order_id").where(~F.col("order_status").isin("Canceled", "Unavailable")).limit(1)
    got = maintain.product_daily_metrics(
        stored, lines, orders, lines, orders, changed=one, as_of="2019-01-01 00:00:00"
    )
    times = {str(r[0]): r[1] for r in got.groupBy("created_at").count().collect()}
    assert sum(times.values()) == stored.count() and times[at] > times["2019-01-01 00:00:00"] > 0


def test_odd_facts_are_maintained_like_rebuilt_ones(spark, facts, rows):
    """Orders with one id on several days, facts without an id, a product or a date, repeated rows."""
    orders, lines = facts
    key, at = F.col("order_id"), "2018-12-31 00:00:00"
    later = F.col("order_purchase_datetime") + F.expr("interval 3 days")
    orders = (
        orders.unionByName(orders.where(key % 7 == 0).withColumn("order_purchase_datetime", later))
        .unionByName(orders.where(key % 11 == 0).withColumn("order_purchase_datetime", F.lit(None).cast("timestamp_ntz")))
        .unionByName(orders.where(key % 13 == 0).withColumn("order_id", F.lit(None).cast("long")))
        .unionByName(orders.where(key % 17 == 0))
    )
    none = F.when(key % 5 != 0, F.col("product_id"))
    lines = (
        lines.withColumn("product_id", none)
        .unionByName(lines.where(key % 13 == 0).withColumn("order_id", F.lit(None).cast("long")))
        .unionByName(lines.where(key % 17 == 0))
    ).checkpoint()
    orders = orders.checkpoint()
    priced = F.when(key % 35 == 0, F.col("item_price") + 1).otherwise(F.col("item_price"))
    after_lines = lines.withColumn("item_price", priced).where("order_id is null or order_id % 19 > 0")
    moved = F.when(key.isNull() | (key % 23 == 0), later).otherwise(F.col("order_purchase_datetime"))
    after_orders = orders.withColumn("order_purchase_datetime", moved)
    found = {r[0] for r in maintain.changed_keys(orders, after_orders, "order_id").collect()}
    assert None in found and not {r[0] for r in maintain.changed_keys(orders, orders, "order_id").collect()}
    stored = core.fact_product_daily_metrics(lines, orders, as_of=at).checkpoint()
    got = maintain.product_daily_metrics(stored, lines, orders, after_lines, after_orders, as_of=at)
    wanted = core.fact_product_daily_metrics(after_lines, after_orders, as_of=at)
    assert rows(got) == rows(wanted.select(*got.columns))
    sales = maintain.daily_sales(core.agg_daily_sales(orders).checkpoint(), orders, after_orders)
    assert rows(sales) == rows(core.agg_daily_sales(after_orders).select(*sales.columns))


def test_only_lines_of_touched_products_and_days_are_aggregated(spark, facts, monkeypatch):
    """Most products and most days are touched, but few pairs of them."""
    orders, lines = facts
    seen = []
    build = core.fact_product_daily_metrics
    monkeypatch.setattr(
        core, "fact_product_daily_metrics", lambda ls, os, **k: seen.append((ls.count(), os)) or build(ls, os, **k)
    )
    stored = build(lines, orders, as_of="2018-12-31").checkpoint()
    some = orders.select("order_id").where("order_id % 10 = 0")
    maintain.product_daily_metrics(stored, lines, orders, lines, orders, changed=some, as_of="2018-12-31")
    (n, _), changed = seen[0], lines.join(some, "order_id", "left_semi").count()
    # A bitmap of 16 bits a key marks one in sixteen others.
    assert changed <= n < changed + lines.count() / 10
