"""Maintenance of stored aggregates by the keys that a change of the facts touches.

Instead of building an aggregate again from all facts, the orders that changed are mapped to the keys
they had before and have now. Only rows of these keys are read, aggregated by the model's own
function, and put in the place of the stored ones. A removed order has keys on the old side, a new
one on the new side, a changed one on both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions import day_of
from martwright.operators.durable import durable
from martwright.operators.marking import perhaps_in
from martwright.plans import core


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys whose rows differ between two states of a table.

    Rows count with their hashes; a key whose sums are equal on both sides has not changed. Rows are
    reduced to their keys before the sides meet, which takes no shuffle where both are bucketed on the
    key; only what differs is shuffled after. Halves of the hashes are summed, which no number of
    rows lets overflow.
    """
    sums = ["_rows", "_high0", "_low0", "_high1", "_low1"]

    def summed(rows: DataFrame, side: str) -> DataFrame:
        values = [F.col(c) for c in sorted(rows.columns)]
        halves = []
        for i, whole in enumerate((F.xxhash64(*values), F.xxhash64(F.lit(7), *values))):
            halves += [
                F.shiftright(whole, 32).alias(f"_high{i}"),
                whole.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"_low{i}"),
            ]
        counted = rows.select(F.col(key).alias(side), F.lit(1).alias("_rows"), *halves)
        return counted.groupBy(side).agg(*[F.sum(c).alias(side + c) for c in sums])

    both = summed(old, "_old").join(summed(new, "_new"), F.col("_old") == F.col("_new"), "full")
    differences = [
        (F.coalesce("_new" + c, F.lit(0)) - F.coalesce("_old" + c, F.lit(0))).alias(c) for c in sums
    ]
    differ = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in sums])
    # A null key meets no other in the join, so its two sides are added here.
    return (
        both.select(F.coalesce("_old", "_new").alias(key), *differences)
        .where(differ)
        .groupBy(key)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .where(differ)
        .select(key)
    )


def changed_orders(
    old_lines: DataFrame, old_orders: DataFrame, new_lines: DataFrame, new_orders: DataFrame
) -> DataFrame:
    """Orders that differ themselves or in their lines: ``order_id``, each once."""
    parts = [
        changed_keys(old_orders, new_orders, "order_id"),
        changed_keys(old_lines, new_lines, "order_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _named(df: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """The distinct keys under other names, and the condition that a row of ``df`` has one."""
    own = [F.col(n).cast(df.schema[n].dataType).alias(f"_k_{n}") for n in names]
    same = [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names]
    return keys.select(*own).distinct(), reduce(lambda a, b: a & b, same)


def _marked(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with ``_perhaps``, which is false only for rows without a key."""
    few = [F.col(n).cast(df.schema[n].dataType) for n in names]
    return perhaps_in(df, [F.col(n) for n in names], keys, few)


def _touched(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``df`` with a key; nulls are equal. Only rows that a bitmap marks are shuffled."""
    renamed, same = _named(df, keys, names)
    marked = _marked(df, keys, names).where("_perhaps").drop("_perhaps")
    return marked.join(renamed, same, "left_semi")


def _replaced(
    stored: DataFrame, fresh: DataFrame, keys: DataFrame, names: list[str]
) -> DataFrame:
    """The stored rows without a key and the fresh ones with one. ``stored`` is read twice."""
    renamed, same = _named(stored, keys, names)
    marked = _marked(stored, keys, names)
    far = marked.where(~F.col("_perhaps")).drop("_perhaps")
    kept = marked.where("_perhaps").drop("_perhaps").join(renamed, same, "left_anti")
    renamed, same = _named(fresh, keys, names)
    again = fresh.join(renamed, same, "left_semi")
    return far.unionByName(kept).unionByName(again.select(*stored.columns))


def daily_sales(
    stored: DataFrame, old_orders: DataFrame, new_orders: DataFrame, changed: DataFrame | None = None
) -> DataFrame:
    """``agg_daily_sales`` of the new orders from its stored state for the old ones.

    ``changed`` lists the orders (``order_id``) that may differ; without it they are found by
    comparison. All orders of a touched day are aggregated again.
    """
    if changed is None:
        changed = durable(changed_keys(old_orders, new_orders, "order_id"))
    day = day_of("order_purchase_datetime").alias("order_date")
    sides = [_touched(o, changed, ["order_id"]).select(day) for o in (old_orders, new_orders)]
    keys = durable(reduce(DataFrame.unionByName, sides).distinct())
    dated = new_orders.withColumn("order_date", day)
    fresh = core.agg_daily_sales(_touched(dated, keys, ["order_date"]))
    return _replaced(stored, fresh, keys, ["order_date"])


def product_daily_metrics(
    stored: DataFrame,
    old_lines: DataFrame,
    old_orders: DataFrame,
    new_lines: DataFrame,
    new_orders: DataFrame,
    changed: DataFrame | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """``fact_product_daily_metrics`` of the new facts from its stored state for the old ones.

    A touched (product, day) is aggregated again from the lines of its product in orders of its day.
    Rows that are kept keep their ``created_at``.
    """
    # Changes and keys are used several times, but the states are compared once.
    if changed is None:
        changed = durable(changed_orders(old_lines, old_orders, new_lines, new_orders))
    names = ["product_id", "order_date"]
    day = day_of("order_purchase_datetime").alias("order_date")

    def keys_of(lines: DataFrame, orders: DataFrame) -> DataFrame:
        own = _touched(lines.select("order_id", "product_id"), changed, ["order_id"])
        dated = _touched(orders.select("order_id", day), changed, ["order_id"])
        return own.join(dated, "order_id").select(*names)

    keys = durable(
        keys_of(old_lines, old_orders).unionByName(keys_of(new_lines, new_orders)).distinct()
    )
    fresh = core.fact_product_daily_metrics(
        _lines_of(new_lines, new_orders, keys, names), new_orders, as_of=as_of
    )
    return _replaced(stored, fresh, keys, names)


def _lines_of(lines: DataFrame, orders: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The lines of each touched (product, day), and few others.

    Lines meet the day of their order, which takes no shuffle where both are bucketed on the order, and
    are then marked where they lie. An id of orders with several days keeps all its lines.
    """
    columns = lines.columns
    product, day = names
    when = day_of("order_purchase_datetime")
    one = F.min(when).eqNullSafe(F.max(when)) & F.count(when).isin(F.lit(0), F.count(F.lit(1)))
    days = orders.groupBy(F.col("order_id").alias("_order")).agg(
        F.min(when).alias(day), one.alias("_one")
    )
    marked = _marked(lines.join(days, F.col("order_id") == F.col("_order")), keys, [product, day])
    return marked.where(F.col("_perhaps") | ~F.col("_one")).select(*columns)
