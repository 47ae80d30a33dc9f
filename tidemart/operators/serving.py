"""What the dashboard asks for: totals, and today against yesterday by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions.columns import money_sum, previous_day
from tidemart.schemas import CARD_NAMES

METRICS = ("dau", "new_mid", "order_amount")


def totals_card(dau: DataFrame, new_mids: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """(id, name, value) for the three totals of one day.

    ``dau`` and ``new_mids`` have a ``log_date``; ``orders`` a ``create_date``
    and ``total_amount``.
    """
    def card(key: str, total: DataFrame) -> DataFrame:
        return total.select(F.lit(key).alias("id"), F.lit(CARD_NAMES[key]).alias("name"),
                            F.col("value").cast("double").alias("value"))

    count = F.count("*").alias("value")
    amount = money_sum(F.col("total_amount")).alias("value")
    return (card("dau", dau.where(F.col("log_date") == day).agg(count))
            .unionByName(card("new_mid", new_mids.where(F.col("log_date") == day).agg(count)))
            .unionByName(card("order_amount", orders.where(F.col("create_date") == day)
                              .agg(amount))))


def _two_days(rows: DataFrame, date: str, hour: str, day: str,
              measure: Column | None) -> DataFrame:
    """One scan of both days; NULL where a day has no row in an hour."""
    def over(which: str) -> Column:
        here = F.col(date) == which
        if measure is None:
            return F.nullif(F.count(F.when(here, 1)), F.lit(0).cast("bigint")).cast("double")
        return money_sum(F.when(here, measure))

    before = previous_day(day)
    return (rows.where(F.col(date).isin(before, day))
            .groupBy(F.col(hour).alias("hour"))
            .agg(over(before).alias("yesterday"), over(day).alias("today")))


def metric_rows(metric: str, day: str, *, dau: DataFrame, new_mids: DataFrame,
                orders: DataFrame) -> DataFrame:
    """(hour, yesterday, today) of one metric for the hours that have rows."""
    if metric == "dau":
        return _two_days(dau, "log_date", "log_hour", day, None)
    if metric == "new_mid":
        return _two_days(new_mids, "log_date", "log_hour", day, None)
    if metric == "order_amount":
        return _two_days(orders, "create_date", "create_hour", day, F.col("total_amount"))
    none = _two_days(dau, "log_date", "log_hour", day, None)
    return none.where(F.lit(False))


def metric_hours(spark: SparkSession, metric: str, day: str, **tables: DataFrame) -> DataFrame:
    """The comparison on the full 24-hour axis, gaps filled with 0.

    An unknown metric gives no rows.
    """
    rows = metric_rows(metric, day, **tables)
    if metric not in METRICS:
        return rows
    axis = spark.range(24).select(
        F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    return (axis.join(rows, "hour", "left")
            .select("hour", F.coalesce("yesterday", F.lit(0.0)).alias("yesterday"),
                    F.coalesce("today", F.lit(0.0)).alias("today")))


def totals_payload(card: DataFrame) -> DataFrame:
    """The totals as one JSON array text (three entries)."""
    order = F.array_position(F.lit(list(METRICS)), F.col("id"))
    entries = F.sort_array(F.collect_list(F.struct(
        order.alias("at"), "id", "name", "value")))
    return card.agg(F.to_json(F.transform(entries, lambda e: F.struct(
        e["id"].alias("id"), e["name"].alias("name"), e["value"].alias("value")))).alias("value"))


def hours_payload(rows: DataFrame) -> DataFrame:
    """{"yesterday": {hour: value}, "today": {hour: value}} as one JSON text.

    At most 24 hours per day enter the two maps.
    """
    def by_hour(column: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(
            F.col(column).isNotNull(), F.struct("hour", F.col(column).alias("v")))))
        return F.map_from_entries(pairs).alias(column)

    return rows.agg(by_hour("yesterday"), by_hour("today")).select(
        F.to_json(F.struct("yesterday", "today")).alias("value"))
