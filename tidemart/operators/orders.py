"""Order rows: cleaning, order value (GMV) by day and hour, last write per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.functions.columns import (
    day_of_text, hour_before_colon, hour_of_text, mask_phone, money_sum)
from tidemart.operators.keyed import last_per_key


def clean_orders(orders: DataFrame, hour: str = "position") -> DataFrame:
    """Mask the phone and derive ``create_date`` / ``create_hour``.

    ``hour`` chooses how the hour is read from ``create_time``: by fixed
    position or by what precedes the colon. Both agree on zero-padded times.
    """
    read_hour = {"position": hour_of_text, "colon": hour_before_colon}[hour]
    columns = {
        "create_hour": read_hour(F.col("create_time")),
        "create_date": day_of_text(F.col("create_time")),
    }
    if "consignee_tel" in orders.columns:
        columns["consignee_tel"] = mask_phone(F.col("consignee_tel"))
    return orders.withColumns(columns)


def gmv_total(orders: DataFrame, day: str) -> DataFrame:
    """Order value of one day; NULL when the day has no order."""
    return (orders.where(F.col("create_date") == day)
            .agg(money_sum(F.col("total_amount")).alias("sum_amount")))


def gmv_by_day(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("create_date")
            .agg(money_sum(F.col("total_amount")).alias("sum_amount")))


def gmv_by_hour(orders: DataFrame, day: str | None = None) -> DataFrame:
    """Order value by hour (one day, or all days)."""
    rows = orders if day is None else orders.where(F.col("create_date") == day)
    keys = ["create_hour"] if day else ["create_date", "create_hour"]
    return rows.groupBy(*keys).agg(money_sum(F.col("total_amount")).alias("sum_amount"))


def last_write(orders: DataFrame, *order: str) -> DataFrame:
    """The last version of each order id by change time."""
    return last_per_key(orders.where(F.col("id").isNotNull()), ["id"], *(order or ("change_ts",)))


def sales_by_province(orders: DataFrame, users: DataFrame, provinces: DataFrame) -> DataFrame:
    """Orders, order value and value class per province.

    ``orders`` (user_id, total_amount) are first summed per user. That uses the
    same shuffle key as the join with ``users`` (id, province_id), so it adds no
    exchange, and a user with a third of all orders is down to one row before
    the join. Classes are steps of 100 orders from 0 to 600, the last one open.
    """
    per_user = (orders.groupBy("user_id")
                .agg(F.count("*").alias("n"),
                     F.sum(F.col("total_amount").cast("decimal(24,4)")).alias("amount")))
    per_province = (per_user.join(users.select(F.col("id").alias("user_id"), "province_id"),
                                  "user_id", "left")
                    .groupBy("province_id")
                    .agg(F.sum("n").alias("order_count"),
                         F.sum("amount").cast("double").alias("sales_amount")))
    return classed_provinces(per_province, provinces)


def classed_provinces(per_province: DataFrame, provinces: DataFrame) -> DataFrame:
    """Name the provinces and put each into its value class."""
    step = F.width_bucket(F.col("order_count").cast("double"), F.lit(0.0), F.lit(600.0), F.lit(6))
    return (per_province.join(provinces, "province_id", "left")
            .select("province_id", "province_name", "order_count", "sales_amount",
                    F.least(step, F.lit(6).cast("bigint")).alias("value_class")))


def order_sales_by_province(orders: DataFrame, provinces: DataFrame) -> DataFrame:
    """The same report when the orders carry ``province_id`` themselves."""
    per_province = (orders.groupBy("province_id")
                    .agg(F.count("*").alias("order_count"),
                         money_sum(F.col("total_amount")).alias("sales_amount")))
    return classed_provinces(per_province, provinces)
