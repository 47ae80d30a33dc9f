"""Daily active devices: first record per device and day, new devices, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.functions.columns import day_of, hour_of
from tidemart.operators.keyed import first_per_key

DAY_KEY = ["mid", "log_date"]


def first_of_day(logs: DataFrame, *tie: str) -> DataFrame:
    """The earliest record of each device on each day.

    ``tie`` names columns that tell records of the same millisecond apart.
    """
    return first_per_key(logs.where(F.col("mid").isNotNull()), DAY_KEY, "ts", *tie,
                         total=bool(tie))


def drop_seen(firsts: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``firsts`` whose device and day are not in ``seen`` yet.

    Shuffled, both sides use the key ``firsts`` is already placed by.
    """
    return firsts.join(seen.select(*DAY_KEY), DAY_KEY, "left_anti")


def seen_of(firsts: DataFrame, seen: DataFrame) -> DataFrame:
    """The keys of ``seen`` that occur in ``firsts``.

    For a micro-batch against a whole day of devices: the batch keys are the
    small side of this join, so the day is only scanned, and what remains is
    no larger than the batch. Spark broadcasts the batch keys if they are
    small enough and shuffles otherwise; no hint forces either.
    """
    return seen.select(*DAY_KEY).join(firsts.select(*DAY_KEY), DAY_KEY, "left_semi")


def active_days(logs: DataFrame) -> DataFrame:
    """(mid, log_date, first_et): only the first time per device and day.

    Enough for all counts, and cheaper than :func:`first_of_day`: a minimum
    over fixed-width values stays a hash aggregate with map-side combine.
    """
    return (logs.where(F.col("mid").isNotNull())
            .groupBy(*DAY_KEY).agg(F.min("et").alias("first_et")))


def dau_total(dau: DataFrame, day: str) -> DataFrame:
    """Number of active devices of one day."""
    return (dau.where(F.col("log_date") == day)
            .agg(F.count("*").alias("dau")))


def dau_by_day(dau: DataFrame) -> DataFrame:
    return dau.groupBy("log_date").agg(F.count("*").alias("dau"))


def dau_by_hour(dau: DataFrame, day: str | None = None) -> DataFrame:
    """Active devices by the hour of their first record (one day, or all days)."""
    rows = dau if day is None else dau.where(F.col("log_date") == day)
    keys = ["log_hour"] if day else ["log_date", "log_hour"]
    return rows.groupBy(*keys).agg(F.count("*").alias("ct"))


def with_first_hour(days: DataFrame) -> DataFrame:
    """Add ``log_hour`` to the output of :func:`active_days`."""
    return days.withColumn("log_hour", hour_of(F.col("first_et")))


def new_devices(rows: DataFrame, time: str = "first_et") -> DataFrame:
    """(mid, log_date, log_hour) of the first time each device was ever seen.

    ``rows`` are best the activity table (one row per device and day); on raw
    logs ``time`` is ``et``. Either way one aggregation by device.
    """
    return (rows.where(F.col("mid").isNotNull())
            .groupBy("mid").agg(F.min(time).alias("first_et"))
            .select("mid", day_of(F.col("first_et")).alias("log_date"),
                    hour_of(F.col("first_et")).alias("log_hour")))


def new_devices_by_day(rows: DataFrame, time: str = "first_et") -> DataFrame:
    return (new_devices(rows, time).groupBy("log_date")
            .agg(F.count("*").alias("new_devices")))
