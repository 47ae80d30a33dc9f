"""Scalar column expressions. All run inside whole-stage code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemart.schemas import MASK_FILL, MASK_VISIBLE

# Amounts are stored as doubles but summed as decimals, so that a total does
# not depend on the order in which partial sums arrive.
MONEY = "decimal(24,4)"


def event_time(millis: Column) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(millis)


def day_of(ts: Column) -> Column:
    """Day text of a timestamp in the session time zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def hour_of(ts: Column) -> Column:
    """Two-digit hour text of a timestamp in the session time zone."""
    return F.date_format(ts, "HH")


def day_of_text(datetime_text: Column) -> Column:
    return F.split_part(datetime_text, F.lit(" "), F.lit(1))


def hour_of_text(datetime_text: Column) -> Column:
    """Hour as the first two characters of the time part."""
    return F.substring(F.split_part(datetime_text, F.lit(" "), F.lit(2)), 1, 2)


def hour_before_colon(datetime_text: Column) -> Column:
    """Hour as what stands before the first colon of the time part."""
    time_part = F.split_part(datetime_text, F.lit(" "), F.lit(2))
    return F.split_part(time_part, F.lit(":"), F.lit(1))


def previous_day(day: str) -> str:
    return (dt.date.fromisoformat(day) - dt.timedelta(days=1)).isoformat()


def next_day(day: str) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=1)).isoformat()


def mask_phone(phone: Column) -> Column:
    """Keep the first characters, hide the rest behind a fixed-length fill."""
    return F.concat(F.substring(phone, 1, MASK_VISIBLE), F.lit(MASK_FILL))


def age_in_years(birthday: Column, as_of: Column | str) -> Column:
    """Whole 365-day years, truncated toward zero; NULL for an unreadable date."""
    born = F.try_to_date(birthday, "yyyy-MM-dd")
    today = F.to_date(F.lit(as_of) if isinstance(as_of, str) else as_of)
    return (F.datediff(today, born) / F.lit(365)).cast("int")


def number(text: Column, kind: str = "double") -> Column:
    """Text as a number, NULL when it is not one."""
    return text.try_cast(kind)


def money_sum(amount: Column) -> Column:
    return F.sum(amount.cast(MONEY)).cast("double")


def index_name(prefix: str, day: Column, separator: str = "_") -> Column:
    """Name of the daily index a document belongs to."""
    return F.concat(F.lit(prefix + separator), day)


def document(*columns: str) -> Column:
    """The named columns as one JSON text."""
    return F.to_json(F.struct(*columns))
