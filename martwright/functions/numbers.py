"""Exact decimal arithmetic and threshold ladders."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

_COMPARE = {">=": operator.ge, "<=": operator.le}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    return _col(value).cast(MONEY)


def r2(value: Column | str) -> Column:
    """Round half up to two places, through a decimal so that ties do not depend on binary floats."""
    return F.round(_col(value).cast("decimal(38,10)"), 2)


def quotient(numerator: Column | str, denominator: Column | str) -> Column:
    """Decimal division kept to ten places; NULL for a zero denominator.

    Ten places leave room to scale the result (x30, x100, /30) without Spark
    shrinking the decimal scale.
    """
    num = _col(numerator).cast("decimal(28,6)")
    den = _col(denominator).cast("decimal(28,6)")
    return (num / F.nullif(den, F.lit(0))).cast("decimal(28,10)")


def ladder(
    value: Column | str,
    steps: Sequence[tuple[object, object]],
    otherwise: object,
    op: str = ">=",
) -> Column:
    """First step whose bound holds wins; NULL values fall through to ``otherwise``."""
    value, compare = _col(value), _COMPARE[op]
    chain = None
    for bound, result in steps:
        hit = compare(value, F.lit(bound))
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_when(condition: Column, value: Column | str) -> Column:
    """Sum of ``value`` over matching rows, counting the others as zero."""
    return F.sum(F.when(condition, _col(value)).otherwise(F.lit(0).cast(MONEY)))
