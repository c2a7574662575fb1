"""Date text cleaning and time differences.

All timestamps of the model are zone-free (``timestamp_ntz``), so results do not
depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three numbers, then perhaps an hour with a colon, a minute and a second.
_LOOSE = (
    r"^(\d{1,4})[/\\-](\d{1,2})[/\\-](\d{1,4})"
    r"(?:\s+(\d{1,2}):(?:(\d{1,2})(?::(\d{1,2}))?)?)?$"
)
_BETWEEN = "\u0001"
_YEAR_FIRST = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_MONTH_FIRST = r"^(\d{2})-(\d{2})-(\d{4}) (\d{2}:\d{2}:\d{2})$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` takes it."""
    return F.transform(F.array(value), use)[0]


def _is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def _two_digits(part: Column) -> Column:
    return F.lpad(part, F.greatest(F.length(part), F.lit(2)), "0")


def clean_datetime_string(text: Column | str) -> Column:
    """Bring loose date text to ``<date> HH:MM:SS`` with dashes and padded parts.

    The first two numbers of the date are padded to two digits; the last one is not, so the day of
    ``2018-2-6`` stays as it is. Missing time parts are zeros. Text of any other form gets
    zeros for a time and is otherwise left alone; blank text gives NULL. (The SQL this rule
    comes from escapes its patterns twice, which makes it reject nearly every full timestamp; the
    rule here is the one it was meant to be.)
    """
    text = _col(text)
    found = F.regexp_replace(text, _LOOSE, _BETWEEN.join(f"${i}" for i in range(1, 7)))

    def padded(parts: Column) -> Column:
        first, second, third, hour, minute, second_of = (parts[i] for i in range(6))
        date = F.concat_ws("-", _two_digits(first), _two_digits(second), third)
        time = F.concat_ws(":", *map(_two_digits, (hour, minute, second_of)))
        return F.when(F.size(parts) == 6, F.concat_ws(" ", date, time))

    clean = F.coalesce(
        _once(F.split(found, _BETWEEN, -1), padded), F.concat(text, F.lit(" 00:00:00"))
    )
    return F.when(_is_blank(text), F.lit(None).cast("string")).otherwise(clean)


def standardize_to_datetime(text: Column | str) -> Column:
    """Timestamp from loose date text; year-first or month-first, anything else NULL."""

    def iso(clean: Column) -> Column:
        turned = F.regexp_replace(clean, _MONTH_FIRST, "$3-$1-$2 $4")
        return F.when(turned.rlike(_YEAR_FIRST), turned)

    return _once(clean_datetime_string(text), iso).try_cast("timestamp_ntz")


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact seconds, negative when ``later`` is the earlier one."""
    gap = _col(later) - _col(earlier)
    return gap.cast("interval second").cast("decimal(20,6)")


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier).cast("double") / F.lit(3600.0)


def whole_days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days, truncated toward zero in both directions."""
    gap = _col(later).cast("timestamp_ntz") - _col(earlier).cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), gap).cast("int")
