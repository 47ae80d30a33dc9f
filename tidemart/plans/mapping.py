"""The driver's tables read as the feeds of the warehouse.

Every function takes whole tables; what a table lacks is derived from its own
columns by a fixed expression, which the oracle SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions.parse import with_log_days

AS_OF = "2024-06-01"
RECEIVED_FROM = 1_704_067_200  # 2024-01-01 00:00:00 UTC
EVENT_NAMES = {"view": "coupon", "click": "clickItem", "purchase": "addCart",
               "signup": "addFavor", "error": "addComment"}


# Known layouts: no job has to open files only to learn their columns.
LAYOUTS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    return spark.readStream.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}*.parquet")


def on_days(events: DataFrame, first: str, last: str) -> DataFrame:
    """Events of the days ``first`` to ``last``: a range on ``ts`` the scan can use."""
    start = F.lit(first).cast("timestamp_ntz")
    end = F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return events.where((F.col("ts") >= start) & (F.col("ts") < end))


def on_order_days(orders: DataFrame, first: str, last: str) -> DataFrame:
    """Orders of the days ``first`` to ``last``; they are created on their order date."""
    day = F.col("o_orderdate")
    return orders.where((day >= F.lit(first).cast("date"))
                        & (day < F.lit(last).cast("date") + F.expr("INTERVAL 1 DAY")))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _amount_text(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)").cast("string")


def start_logs(events: DataFrame) -> DataFrame:
    """Start log: one record per event of the device in ``props``.

    The generator keeps the device from being read out of the JSON a second
    time for the filter on it.
    """
    return events.select(
        F.explode(F.array(F.get_json_object("props", "$.k"))).alias("mid"), _text("user_id").alias("uid"),
        F.when(F.col("event_type") == "signup", "startup").otherwise("event").alias("type"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id",
        F.col("ts").cast("timestamp").alias("et"))


def timed_start_logs(events: DataFrame) -> DataFrame:
    return with_log_days(start_logs(events))


def event_logs(events: DataFrame) -> DataFrame:
    """Event log: ten shared devices, so that several users meet on one."""
    name = F.lit(None).cast("string")
    for kind, evid in EVENT_NAMES.items():
        name = F.when(F.col("event_type") == kind, evid).otherwise(name)
    return events.select(
        F.concat(F.lit("mid_"), (F.col("user_id") % 10).cast("string")).alias("mid"),
        _text("user_id").alias("uid"), name.alias("evid"), _text("event_id").alias("itemid"), "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("ts").cast("timestamp").alias("et"))


def order_feed(orders: DataFrame, *extra: str) -> DataFrame:
    """Order rows as text values; the time of day comes from the order key."""
    second = F.col("o_orderkey") * 7919 % 86400
    created = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + second)
    phone = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
             .when(F.col("o_orderstatus") == "P", (F.col("o_custkey") % 1000).cast("string"))
             .otherwise(F.concat(F.lit("138"), F.lpad(_text("o_custkey"), 8, "0"))))
    return orders.select(
        _text("o_orderkey").alias("id"), _text("o_custkey").alias("user_id"),
        _amount_text("o_totalprice").alias("total_amount"),
        F.col("o_orderstatus").alias("order_status"), phone.alias("consignee_tel"),
        F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.timestamp_seconds(F.lit(RECEIVED_FROM) + F.col("o_orderkey") % 86400).alias("rt"), *extra)


def typed_orders(orders: DataFrame) -> DataFrame:
    return order_feed(orders, "o_totalprice").drop("total_amount").withColumnRenamed(
        "o_totalprice", "total_amount")


def purchases(events: DataFrame) -> DataFrame:
    """Purchase events as orders, at the time they happened."""
    happened = F.col("ts").cast("timestamp")
    return events.where(F.col("event_type") == "purchase").select(
        _text("event_id").alias("id"), F.col("value").alias("total_amount"),
        F.date_format(happened, "yyyy-MM-dd HH:mm:ss").alias("create_time"))


def detail_feed(lines: DataFrame, parts: DataFrame, *extra: str) -> DataFrame:
    """Order lines; the receive time lies up to 200 s around that of the order."""
    names = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return line_feed(lines.join(names, "l_partkey", "left"), F.col("p_name").alias("sku_name"), *extra)


def line_feed(lines: DataFrame, *extra: Column | str) -> DataFrame:
    """The columns of an order line that need no part."""
    gap = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 61) % 400 - 200
    count = F.col("l_quantity").cast("int").cast("string")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", count)
        .alias("id"),
        _text("l_orderkey").alias("order_id"),
        _text("l_partkey").alias("sku_id"), _amount_text("l_extendedprice").alias("order_price"),
        count.alias("sku_num"),
        F.timestamp_seconds(F.lit(RECEIVED_FROM) + F.col("l_orderkey") % 86400 + gap).alias("rt"), *extra)


def typed_details(lines: DataFrame, parts: DataFrame) -> DataFrame:
    return detail_feed(lines, parts, "l_extendedprice").drop("order_price").withColumnRenamed(
        "l_extendedprice", "order_price")


def user_feed(customers: DataFrame) -> DataFrame:
    """Users; customers in debt have no profile, so some orders lack a user."""
    born = F.date_add(F.lit("1960-01-01").cast("date"),
                      (F.col("c_custkey") * 37 % 20000).cast("int"))
    return customers.where(F.col("c_acctbal") >= 0).select(
        _text("c_custkey").alias("id"), F.col("c_name").alias("login_name"),
        F.col("c_mktsegment").alias("user_level"),
        F.date_format(born, "yyyy-MM-dd").alias("birthday"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"))


def user_changes(customers: DataFrame) -> DataFrame:
    """An insert per user and an update of the level of each HOUSEHOLD user."""
    inserted = user_feed(customers).withColumn(
        "change_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    updated = (inserted.where(F.col("user_level") == "HOUSEHOLD")
               .withColumns({"user_level": F.lit("VIP"),
                             "change_ts": F.lit("2024-02-01 00:00:00").cast("timestamp")}))
    return inserted.unionByName(updated)


def order_changes(orders: DataFrame) -> DataFrame:
    """An insert per order and a later version of each order in status P."""
    first = typed_orders(orders).withColumnRenamed("rt", "change_ts")
    later = (first.where(F.col("order_status") == "P")
             .withColumns({"order_status": F.lit("F"),
                           "total_amount": F.col("total_amount") + 1,
                           "change_ts": F.col("change_ts") + F.expr("INTERVAL 1 DAY")}))
    return first.unionByName(later)


def raw(rows: DataFrame, *columns: str, at: Column) -> DataFrame:
    """Records as a source delivers them: JSON text and arrival time."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"), at.alias("timestamp"))


def _change(rows: DataFrame, entry: Column, name: str, op: Column, ts: Column,
            columns: list[str]) -> DataFrame:
    pairs = [x for c in columns for x in (F.lit(c), F.col(c))]
    return rows.select(entry.alias("entry_type"), F.lit(name).alias("table"), op.alias("op"),
                       ts.alias("ts"), F.create_map(*pairs).alias("after"))


def change_feed(orders: DataFrame, lines: DataFrame, parts: DataFrame,
                customers: DataFrame) -> DataFrame:
    """Row changes of all tables, wanted and unwanted ones.

    Orders in status F are updates and those in status P deletes; order keys
    of status O stay inserts, and the urgent ones come as transaction marks.
    """
    row, insert = F.lit("ROWDATA"), F.lit("INSERT")
    order_rows = order_feed(orders, "o_orderpriority")
    order_op = (F.when(F.col("order_status") == "F", "UPDATE")
                .when(F.col("order_status") == "P", "DELETE").otherwise("INSERT"))
    mark = F.when(F.col("o_orderpriority") == "1-URGENT", "TRANSACTIONEND").otherwise("ROWDATA")
    users = user_changes(customers)
    user_op = F.when(F.col("user_level") == "VIP", "UPDATE").otherwise("INSERT")
    return (_change(order_rows, mark, "order_info", order_op, F.col("rt"),
                    ["id", "user_id", "total_amount", "create_time"])
            .unionByName(_change(line_feed(lines), row, "order_detail", insert,
                                 F.col("rt"), ["id", "order_id", "sku_id", "order_price"]))
            .unionByName(_change(users, row, "user_info", user_op, F.col("change_ts"),
                                 ["id", "user_level", "birthday", "gender"]))
            .unionByName(_change(parts.select(_text("p_partkey").alias("id"), "p_name"), row,
                                 "sku_info", insert, F.timestamp_seconds(F.lit(RECEIVED_FROM)),
                                 ["id", "p_name"])))
