"""JSON text -> typed rows, with unreadable records kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.functions.columns import (
    MONEY, day_of, event_time, hour_of, number)
from tidemart.schemas import FEEDS, Feed

_BROKEN = "_broken"
_DATED = r"^\d{4}-\d{2}-\d{2} \S"
_LAST_MILLI = 253_402_300_799_999  # end of the year 9999


def _usable(text: Column, kind: str) -> Column:
    """A number that later steps can take: a time of a four-digit year, or an
    amount that fits the decimal it is summed as."""
    if kind == "bigint":
        fits = number(text, kind).between(0, _LAST_MILLI)
    else:
        fits = number(text, kind).isNotNull() & number(text, MONEY).isNotNull()
    return F.coalesce(fits, F.lit(False))


def parsed_once(value: Column, layout: T.StructType | str) -> Column:
    """The JSON text as a struct column that is parsed a single time per row.

    A plain ``from_json`` column would be copied into every filter on one of
    its fields, so a record would be parsed again for each check. A generator
    is a border no filter is moved across.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    return F.explode(F.array(F.from_json(value, layout, options)))


def is_broken(doc: str) -> Column:
    return F.col(doc).isNull() | F.col(f"{doc}.{_BROKEN}").isNotNull()


def parse_feed(raw: DataFrame, feed: Feed | str) -> DataFrame:
    """One typed row per record of ``raw`` (a ``value`` text column).

    The result carries ``error`` (NULL for a good record), the original
    ``value`` and, when the source has it, ``timestamp``. Use :func:`good` and
    :func:`quarantined` to split it.
    """
    feed = FEEDS[feed] if isinstance(feed, str) else feed
    layout = T.StructType([*feed.schema.fields, T.StructField(_BROKEN, T.StringType())])
    kept = [c for c in ("timestamp",) if c in raw.columns]
    rows = raw.select("value", *kept, parsed_once(F.col("value"), layout).alias("doc"))

    checks = [(is_broken("doc"), "malformed")]
    checks += [(F.col(f"doc.{name}").isNull(), f"missing {name}") for name in feed.required]
    checks += [(F.col(f"doc.{name}").isNotNull() & ~_usable(F.col(f"doc.{name}"), kind),
                f"bad {name}") for name, kind in feed.numbers.items()]
    if feed.name == "order":
        checks.append((~F.col("doc.create_time").rlike(_DATED), "bad create_time"))

    error = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        error = F.when(test, F.lit(reason)).otherwise(error)

    columns = [
        number(F.col(f"doc.{f.name}"), feed.numbers[f.name]).alias(f.name)
        if f.name in feed.numbers and f.name != "order_price"
        else F.col(f"doc.{f.name}").alias(f.name)
        for f in feed.schema.fields]
    return rows.select(*columns, *kept, "value", error.alias("error"))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error", "value")


def quarantined(parsed: DataFrame) -> DataFrame:
    kept = [c for c in ("timestamp",) if c in parsed.columns]
    return parsed.where(F.col("error").isNotNull()).select("value", *kept, "error")


def parse_changes(raw: DataFrame) -> DataFrame:
    """Row changes (:data:`tidemart.schemas.CHANGE`) from change events as JSON text.

    The time of the change is its ``ts`` or, without one, the time of arrival.
    Events that are no JSON object carry an ``error``; :func:`good` and
    :func:`quarantined` split them off.
    """
    layout = ("entry_type STRING, `table` STRING, op STRING, ts STRING, "
              f"after MAP<STRING, STRING>, {_BROKEN} STRING")
    rows = raw.select("value", "timestamp", parsed_once(F.col("value"), layout).alias("doc"))
    return rows.select(
        "doc.entry_type", "doc.table", "doc.op",
        F.coalesce(F.try_to_timestamp("doc.ts"), F.col("timestamp")).alias("ts"), "doc.after",
        "value", "timestamp", F.when(is_broken("doc"), F.lit("malformed")).alias("error"))


def with_log_time(logs: DataFrame) -> DataFrame:
    """Add ``et`` (event time), ``log_date`` and ``log_hour`` from ``ts`` millis."""
    return with_log_days(logs.withColumn("et", event_time(F.col("ts"))))


def with_log_days(timed: DataFrame) -> DataFrame:
    """Add ``log_date`` and ``log_hour`` from the event time ``et``."""
    return timed.withColumns({"log_date": day_of(F.col("et")), "log_hour": hour_of(F.col("et"))})


def without_time(value: Column) -> Column:
    """A JSON object text without its ``ts``, or NULL if that cannot be told (a name that comes twice).

    A text in which the name does not stand, nor an escape that could spell it, stays as it is and is
    not parsed; the others are taken apart, and their keys then come sorted.
    """
    bare = F.to_json(F.map_filter(
        F.try_parse_json(value).cast("map<string,variant>"), lambda name, _: name != "ts"))
    suspect = F.contains(value, F.lit('"ts"')) | F.contains(value, F.lit("\\u"))
    return F.when(suspect, bare).otherwise(value)


def stamp(bare: Column, arrival: Column) -> Column:
    """Add ``ts`` (arrival millis) at the end of a JSON object text that has none."""
    text = F.trim(bare, F.lit(" \t\r\n"))
    opened = F.substr(text, F.lit(1), F.length(text) - 1)
    comma = F.when(F.trim(opened) == "{", F.lit("")).otherwise(F.lit(","))
    millis = F.unix_millis(arrival).cast("string")
    return F.concat(opened, comma, F.lit('"ts":'), millis, F.lit("}"))
