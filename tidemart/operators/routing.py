"""Which feed a raw log record or a row change belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.parse import is_broken, parsed_once, stamp, without_time
from tidemart.schemas import (
    ROW_ENTRY, STARTUP_TYPE, TOPIC_EVENT, TOPIC_ORDER, TOPIC_ORDER_DETAIL, TOPIC_START,
    TOPIC_USER)

_HEAD = "type STRING, _broken STRING"


def log_topic(log_type: Column) -> Column:
    """Start-ups to the start feed; any other type, or none, to the event feed."""
    return (F.when(log_type == STARTUP_TYPE, F.lit(TOPIC_START))
            .otherwise(F.lit(TOPIC_EVENT)))


def route_logs(raw: DataFrame) -> DataFrame:
    """(topic, value, timestamp, error) of raw device logs, stamped on arrival.

    ``raw`` has ``value`` and ``timestamp`` (arrival time of the source).
    Records that are no JSON object, or bring a ``ts`` and name a field twice, get an ``error`` and
    no topic. Records without a ``ts`` are parsed once, for their type.
    """
    rows = raw.select("value", "timestamp", parsed_once(F.col("value"), _HEAD).alias("head"))
    broken = is_broken("head") | ~F.ltrim("value", F.lit(" \t\r\n")).startswith("{")
    stamped = F.when(~broken, stamp(without_time(F.col("value")), F.col("timestamp")))
    rows = rows.select("value", "timestamp", broken.alias("broken"), "head.type", stamped.alias("stamped"))
    return rows.select(
        F.when(F.col("stamped").isNotNull(), log_topic(F.col("type"))).alias("topic"),
        F.coalesce("stamped", "value").alias("value"), "timestamp",
        F.when(F.col("broken"), F.lit("malformed"))
        .when(F.col("stamped").isNull(), F.lit("repeated name")).alias("error"))


def change_topic(table: Column, op: Column) -> Column:
    """Topic of a row change, NULL when no feed wants it."""
    insert = op == "INSERT"
    return (F.when((table == "order_info") & insert, F.lit(TOPIC_ORDER))
            .when((table == "order_detail") & insert, F.lit(TOPIC_ORDER_DETAIL))
            .when((table == "user_info") & op.isin("INSERT", "UPDATE"), F.lit(TOPIC_USER)))


def route_or_set_aside(parsed: DataFrame) -> DataFrame:
    """(topic, value, timestamp, error) of parsed change events: what :func:`route_changes` sends of the
    good ones, and the unreadable ones as they came, without a topic. Narrow, as both are kept for a batch.
    """
    fine = F.col("error").isNull()
    rows = parsed.where(~fine | (F.col("entry_type") == ROW_ENTRY)).select(
        F.when(fine, change_topic(F.col("table"), F.col("op"))).alias("topic"),
        F.when(fine, F.to_json("after")).otherwise(F.col("value")).alias("value"),
        F.when(fine, F.col("ts")).otherwise(F.col("timestamp")).alias("timestamp"), "error")
    return rows.where(F.col("topic").isNotNull() | F.col("error").isNotNull())


def route_changes(changes: DataFrame) -> DataFrame:
    """(topic, value, timestamp) of the row changes some feed wants.

    Only row data counts; the after-image becomes a flat JSON object whose
    values are all text.
    """
    return (changes
            .where(F.col("entry_type") == ROW_ENTRY)
            .select(change_topic(F.col("table"), F.col("op")).alias("topic"),
                    F.to_json("after").alias("value"),
                    F.col("ts").alias("timestamp"))
            .where(F.col("topic").isNotNull()))
