"""Exact running totals, row numbers, tiles and quantiles without a one-task window.

A window over a whole table, or over a group that may hold a third of it, sorts that
group in a single task. Here the rows are range-partitioned on (group, order) instead,
so a large group is spread over many slices. Each slice is summed on its own, and what
lies before it in the same group is added as an offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.operators.durable import durable


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add the inclusive running total of ``weight`` (default 1: the row number).

    ``order`` must be total within a group. The slice number is stored with the
    rows before it is used, as a second evaluation could cut the ranges elsewhere.
    """
    ranged = durable(
        df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight)
        .repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = ranged.groupBy(*group, "_slice").agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Only the first group of a slice can have begun in an earlier one, so there are
    # fewer offsets than slices and broadcasting them is safe at any data size.
    offsets = (
        totals.withColumn("_before", F.sum("_total").over(earlier))
        .where(F.col("_before").isNotNull())
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_slice").alias("_s"), "_before")
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group],
        F.col("_slice") == F.col("_s"),
    )
    within = (
        Window.partitionBy("_slice", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(F.broadcast(offsets), same, "left")
        .withColumn(name, F.sum("_weight").over(within) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def _edges(rows: int, tiles: int) -> list[int]:
    """Rows in the first 1, 2, ... tiles, when the first ``rows % tiles`` tiles take one more."""
    size, longer = divmod(rows, tiles)
    return [c * size + min(c, longer) for c in range(1, tiles)]


@dataclass(frozen=True)
class _Block:
    """Rows of one measure with one value, at positions ``first`` up to but not with ``upto``."""

    rank: int  # 0 or 1: whether NULL or a value, in the order of the measure
    value: Decimal | None
    first: int
    upto: int

    def before(self, rank: Column, value: Column) -> Column:
        later = rank > self.rank
        if self.value is None:
            return later
        return later | ((rank == self.rank) & (value > F.lit(self.value)))

    def holds(self, rank: Column, value: Column) -> Column:
        same = value.isNull() if self.value is None else value == F.lit(self.value)
        return (rank == self.rank) & same


def ntile_scores(
    df: DataFrame, key: str, scores: dict[str, tuple[str, bool]], tiles: int = 5
) -> DataFrame:
    """Global NTILE for several measures at once: ``key`` plus one column per score.

    ``scores`` maps the output column to (measure, ascending). NULL measures sort as the
    largest value in either direction. Ties are broken by the md5 of the key, then the key.

    Distinct values are counted, and their cumulative counts say in which value each tile ends. A
    row's tile follows from comparing its values with these, which are ``tiles - 1`` for each measure.
    Only rows whose value is cut by the end of a tile are ranked.
    """
    columns = [F.col(key), F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")).alias("_tie")]
    for i, (measure, ascending) in enumerate(scores.values()):
        value = F.col(measure).cast("decimal(28,6)")
        columns += [
            (value.isNull() if ascending else value.isNotNull()).cast("int").alias(f"_rank{i}"),
            (value if ascending else -value).alias(f"_value{i}"),
        ]
    base = durable(df.select(*columns))
    of = [(F.col(f"_rank{i}"), F.col(f"_value{i}")) for i in range(len(scores))]
    entries = [
        F.struct(F.lit(i).alias("_score"), r.alias("_rank"), v.alias("_value"))
        for i, (r, v) in enumerate(of)
    ]
    values = (
        base.select(F.explode(F.array(*entries)).alias("_e"))
        .groupBy("_e._score", "_e._rank", "_e._value")
        .agg(F.count("*").alias("_n"))
    )
    edges = _edges(base.count(), tiles)
    upto = running_total(
        values, ["_score"], [F.col("_rank"), F.col("_value")], "_upto", F.col("_n")
    ).withColumn("_first", F.col("_upto") - F.col("_n"))
    ends = reduce(or_, [(F.col("_first") < e) & (F.col("_upto") >= e) for e in edges], F.lit(False))
    blocks: list[list[_Block]] = [[] for _ in scores]
    for r in upto.where(ends).collect():  # at most tiles - 1 a score
        blocks[r["_score"]].append(_Block(r["_rank"], r["_value"], r["_first"], r["_upto"]))

    plain, tied, parts = [], [], []
    for i, (rank, value) in enumerate(of):
        tile = F.lit(1)
        cut: dict[_Block, list[int]] = {}
        for edge in edges:
            own = next((b for b in blocks[i] if b.first < edge <= b.upto), None)
            if own is None:  # fewer rows than tiles: an edge at the start is behind every row
                tile = tile + (1 if edge == 0 else 0)
                continue
            tile = tile + own.before(rank, value).cast("int")
            if edge < own.upto:
                cut.setdefault(own, []).append(edge - own.first)
        plain.append(tile)
        for b, (block, inner) in enumerate(cut.items()):
            name = F.struct(F.lit(i).alias("_score"), F.lit(b).alias("_block"))
            tied.append(F.when(block.holds(rank, value), name))
            here = (F.col("_score") == i) & (F.col("_block") == b)
            parts += [(here & (F.col("_number") > n)).cast("int") for n in inner]
    if not tied:
        return base.select(key, *[t.cast("int").alias(n) for t, n in zip(plain, scores)])
    ranked = running_total(
        base.select(key, "_tie", F.explode(F.array_compact(F.array(*tied))).alias("_t")).select(
            key, "_tie", "_t.*"
        ),
        ["_score", "_block"],
        [F.col("_tie"), F.col(key)],
        "_number",
    ).withColumn("_more", reduce(add, parts))
    more = ranked.groupBy(F.col(key).alias("_key")).agg(
        *[F.max(F.when(F.col("_score") == i, F.col("_more"))).alias(f"_more{i}") for i in range(len(scores))]
    )
    return base.join(more, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key,
        *[
            (tile + F.coalesce(f"_more{i}", F.lit(0))).cast("int").alias(name)
            for i, (tile, name) in enumerate(zip(plain, scores))
        ],
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column.

    Values are counted first, so only distinct values are ordered. Output:
    ``column_name``, ``distinct_values`` and ``quantiles`` (array in the order of
    ``probabilities``).
    """
    values = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column_name"),
                            F.col(c).cast("double").alias("value"),
                        )
                        for c in columns
                    ]
                )
            ).alias("_v")
        )
        .select("_v.*")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("_n"))
    )
    upto = running_total(values, ["column_name"], [F.col("value")], "_upto", F.col("_n"))
    totals = upto.groupBy("column_name").agg(F.max("_upto").alias("_rows"))
    # One small row per column: the column list itself bounds this side.
    placed = upto.join(F.broadcast(totals), "column_name")
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    picks = []
    for i, p in enumerate(probabilities):
        position = (F.col("_rows") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(
                F.max(F.when((first <= at) & (at <= last), F.col("value"))).alias(f"_{side}{i}")
            )
    picked = placed.groupBy("column_name", "_rows").agg(
        F.count("*").alias("distinct_values"), *picks
    )
    results = []
    for i, p in enumerate(probabilities):
        position = (F.col("_rows") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        results.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share)
    return picked.select("column_name", "distinct_values", F.array(*results).alias("quantiles"))
