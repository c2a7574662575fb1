"""Merkle manifest of a dataset: one root over all rows, and a proof for each of them.

Leaves lie in order within their group. While a group has several nodes, every ``FANOUT``
consecutive ones become one parent; the node left over is the group's subroot, and the subroots,
ordered by group, are reduced in the same way to one root.

Method (slot pivot): conditional aggregates spread the children of a parent into ``FANOUT`` columns.
Concatenating the columns and hashing gives the parent; joined back to a child, the columns to
the left and right of its own slot are its siblings. A group whose first parent has no second child
holds a single node and is finished, so no group sizes are needed.

Scale: positions come from range-partitioned running totals, so a group with a third of all rows
is spread like any other; every aggregation and join is on (group, parent), which holds at
most FANOUT rows. Only digests travel, never texts. Proofs are worked out from the root downwards, so
a step above the leaves is shuffled once for FANOUT leaves. The number of levels is the logarithm
of the largest group.

Defined results: a null field differs from an empty one; rows without group form one group, which
is the first; a null order comes first; equal rows are leaves of their own, next to each other; texts of
any length are hashed whole; an empty table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import stored
from martwright.operators.ordering import running_total

FANOUT = 16
SLOTS = [f"_s{i}" for i in range(FANOUT)]
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts; null ones add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each with its length in bytes, so that no two rows read alike."""
    texts = [field.cast("string") for field in fields]
    return digest(
        *[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    )


def lower_ascii(text: Column) -> Column:
    """A to Z lower-cased, all else left; ``lower`` changes other letters too."""
    return reduce(
        lambda t, code: F.replace(t, F.lit(chr(code)), F.lit(chr(code + 32))), range(65, 91), text
    )


def _parent() -> Column:
    return F.expr(f"_pos div {FANOUT}")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Parents of all levels of (_group, _pos, _node), leaves' parents first.

    ``_done`` rows stand for a finished group, with its last node in the first slot.
    """
    levels = []
    while not nodes.isEmpty():
        slot = F.col("_pos") % FANOUT
        parents = nodes.groupBy("_group", _parent().alias("_pos")).agg(
            *[F.max(F.when(slot == i, F.col("_node"))).alias(s) for i, s in enumerate(SLOTS)]
        )
        done = (F.col("_pos") == 0) & F.col(SLOTS[1]).isNull()
        level = parents.withColumn("_node", digest(*map(F.col, SLOTS))).withColumn("_done", done)
        levels.append(stored(level, f"merkle-level-{len(levels)}"))
        nodes = levels[-1].where(~F.col("_done")).select("_group", "_pos", "_node")
    return levels


def _finished(levels: list[DataFrame]) -> DataFrame:
    """``_group`` and ``_subroot`` of every group."""
    ends = [
        level.where("_done").select("_group", F.col(SLOTS[0]).alias("_subroot")) for level in levels
    ]
    return reduce(DataFrame.unionByName, ends)


def _below(nodes: DataFrame, level: DataFrame, above: DataFrame | None, ends: DataFrame) -> DataFrame:
    """``nodes`` with the subroot and the steps from each of them to the root.

    ``level`` holds their parents, ``above`` the parents' own steps, ``ends`` the steps of finished
    groups.
    """

    def with_path(parents: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
        renamed = known.select(
            *[F.col(k).alias(f"_k{k}") for k in keys], "_subroot", F.col("_path").alias("_up")
        )
        same = reduce(
            lambda a, b: a & b, [parents[k].eqNullSafe(F.col(f"_k{k}")) for k in keys]
        )
        return parents.join(renamed, same).drop(*[f"_k{k}" for k in keys])

    parents = with_path(level.where("_done"), ends, "_group")
    if above is not None:
        open_ones = level.where(~F.col("_done"))
        parents = parents.unionByName(with_path(open_ones, above, "_group", "_pos"))
    parents = parents.withColumnsRenamed({"_group": "_g", "_pos": "_p"}).drop("_node")
    slot = F.col("_pos") % FANOUT
    left, right = (
        F.concat_ws("", *[F.when(own, F.col(s)) for s, own in zip(SLOTS, owns)])
        for owns in (
            [slot > i for i in range(FANOUT)],
            [slot < i for i in range(FANOUT)],
        )
    )
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    path = F.when(F.col("_done"), F.col("_up")).otherwise(F.concat(step, F.col("_up")))
    same = nodes["_group"].eqNullSafe(F.col("_g")) & (_parent() == F.col("_p"))
    return nodes.join(parents, same).select(*nodes.columns, "_subroot", path.alias("_path"))


def _paths(nodes: DataFrame, levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The steps of ``nodes``, the children of the first level, from the top level downwards."""
    above = None
    for below, level in zip(reversed(levels[:-1]), reversed(levels[1:])):
        inner = below.where(~F.col("_done")).select("_group", "_pos")
        above = _below(inner, level, above, ends)
    return _below(nodes, levels[0], above, ends)


def _positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    numbered = running_total(rows, ["_group"], order, "_number")
    return numbered.withColumn("_pos", F.col("_number") - 1).drop("_number")


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf") -> DataFrame:
    """``row`` (all columns of ``rows``), ``subroot``, ``root`` and ``path``.

    ``leaf`` is the hash of a row, see :func:`leaf_hash`. ``path`` holds the siblings to the left
    and right of the row's node on each level, from the leaf to the root.
    """
    spark = rows.sparkSession
    spread = F.xxhash64(F.monotonically_increasing_id())  # deals out equal rows
    leaves = stored(
        rows.select(
            F.struct("*").alias("row"),
            F.col(group).alias("_group"),
            F.col(order).alias("_order"),
            F.col(leaf).alias("_node"),
            spread.alias("_spread"),
        ),
        "merkle-leaves",
    )
    leaves = _positioned(leaves, [F.col(c) for c in ("_order", "_node", "_spread")])
    levels = _levels(leaves.select("_group", "_pos", "_node"))
    if not levels:
        return spark.createDataFrame(
            [], f"row {rows.schema.simpleString()}, subroot string, root string, path array<{STEP}>"
        )
    subroots = stored(
        _finished(levels).select(
            F.lit(0).alias("_group"), F.col("_group").alias("_name"), F.col("_subroot").alias("_node")
        ),
        "merkle-subroots",
    )
    subroots = _positioned(subroots, [F.col("_name")])
    top = _levels(subroots.select("_group", "_pos", "_node"))
    end = _finished(top)
    root = end.first()["_subroot"]
    nothing = F.array().cast(f"array<{STEP}>")
    ends = stored(
        _paths(subroots, top, end.withColumn("_path", nothing)).select(
            F.col("_name").alias("_group"), F.col("_node").alias("_subroot"), "_path"
        ),
        "merkle-groups",
    )
    return _paths(leaves, levels, ends).select(
        "row", F.col("_subroot").alias("subroot"), F.lit(root).alias("root"), F.col("_path").alias("path")
    )


def proof_digest(path: str = "path") -> Column:
    """Hash of all siblings, level by level, left to right."""
    both = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return digest(F.array_join(both, ""))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))
