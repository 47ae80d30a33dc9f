"""From raw records to answers, as the pieces run together."""

import json

from oracle_check import rows
from pyspark.sql import functions as F

from tidemart.functions.columns import previous_day
from tidemart.sources import feeds
from tidemart.streaming.jobs import ONCE
from tidemart.warehouse import Warehouse

DAY = "2024-03-01"


def log(mid, at, kind="startup", **more):
    return json.dumps({"mid": mid, "uid": more.pop("uid", "u"), "type": kind, "at": at, **more})


def change(table, op, at, entry="ROWDATA", **after):
    return json.dumps({"entry_type": entry, "table": table, "op": op, "ts": f"{at}Z",
                       "after": {k: str(v) for k, v in after.items()}})


def test_everything_together(spark, drop_file, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    yesterday = previous_day(DAY)

    # device logs: two days, one device on both, three coupon users on one device
    log_files = drop_file("logs", [log("a", f"{yesterday} 23:10:00"),
                                   log("b", f"{yesterday} 08:00:00")])
    drop_file("logs", [log("a", f"{DAY} 09:00:00"), log("a", f"{DAY} 08:30:00"),
                       log("c", f"{DAY} 08:40:00"), log("d", f"{DAY} 10:00:00"), "no json"])
    drop_file("logs", [log("farm", f"{DAY} 12:00:0{i}", "event", uid=f"u{i}", evid="coupon",
                           itemid=i) for i in range(3)]
              + [log("closing", "2024-03-02 00:00:00", "event", evid="addCart")])
    raw = (spark.readStream.text(log_files).select(
        "value", F.coalesce(F.get_json_object("value", "$.at"), F.lit(f"{DAY} 00:00:00"))
        .cast("timestamp").alias("timestamp")))
    house.route_logs(raw, ONCE).awaitTermination()
    house.count_devices(ONCE).awaitTermination()
    house.watch_coupons(ONCE).awaitTermination()

    # row changes: users, orders and lines, with some nobody wants
    at = f"{DAY}T08:00:00"
    user = dict(login_name="n", birthday="2000-01-01", gender="F")
    first = drop_file("changes", [
        change("user_info", "INSERT", at, id="u1", user_level=1, **user),
        change("user_info", "UPDATE", f"{DAY}T08:00:05", id="u1", user_level=2, **user),
        change("user_info", "DELETE", f"{DAY}T08:00:09", id="u1")])
    order = dict(user_id="u1", consignee_tel="13812345678", province_id=3, order_status="n")
    drop_file("changes", [
        change("order_info", "INSERT", at, id=1, total_amount="10.50",
               create_time=f"{DAY} 08:00:00", **order),
        change("order_info", "UPDATE", at, id=1, total_amount="99", **order),
        change("order_info", "INSERT", at, entry="TRANSACTIONEND", id=9, **order),
        change("order_info", "INSERT", at, id=2, total_amount="1.25",
               create_time=f"{yesterday} 23:59:59", **order),
        change("order_detail", "INSERT", f"{DAY}T08:01:00", id="1a", order_id=1, sku_id="s",
               sku_name="Red Ring", order_price="4.5"),
        change("order_detail", "INSERT", f"{DAY}T08:01:40", id="1b", order_id=1, sku_id="s",
               sku_name="bolt", order_price="6"),
        change("order_detail", "INSERT", f"{DAY}T08:01:41", id="late", order_id=1, sku_id="s",
               sku_name="bolt", order_price="6"),
        change("sku_info", "INSERT", at, id="s")])
    house.route_changes(feeds.read_changes_stream(spark, first), ONCE).awaitTermination()
    house.keep_users(ONCE).awaitTermination()
    house.count_orders(ONCE).awaitTermination()
    house.join_sales(ONCE, as_of="2024-06-01").awaitTermination()

    assert rows(house.devices_of([DAY]).select("mid", "log_hour")) == [
        ("a", "08"), ("c", "08"), ("d", "10")]
    house.close_day(yesterday)
    card = {r.id: r.value for r in house.totals(DAY).collect()}
    assert card == {"dau": 3.0, "new_mid": 2.0, "order_amount": 10.5}
    assert json.loads(house.totals_json(DAY).first()[0])[1]["value"] == 2.0
    assert rows(house.hours("dau", DAY).where("yesterday + today > 0")) == [
        ("08", 1.0, 2.0), ("10", 0.0, 1.0), ("23", 1.0, 0.0)]
    assert json.loads(house.hours_json("new_mid", DAY).first()[0]) == {
        "yesterday": {"08": 1.0, "23": 1.0}, "today": {"08": 1.0, "10": 1.0}}
    assert json.loads(house.hours_json("order_amount", DAY).first()[0]) == {
        "yesterday": {"23": 1.25}, "today": {"08": 10.5}}

    assert rows(house.users().select("id", "user_level")) == [("u1", "2")]
    sold = house.sales_of([DAY]).select("order_detail_id", "user_level", "user_age", "sku_price")
    assert rows(sold) == [("1a", "2", 24, 4.5), ("1b", "2", 24, 6.0)]
    answer = json.loads(house.search_json(day=DAY, keyword="ring").first()[0])
    assert answer["total"] == 1 and answer["detail"][0]["order_detail_id"] == "1a"
    assert answer["stat"][0]["options"][0]["name"] == "20-30岁"
    names = spark.createDataFrame([("3", "north")], "province_id string, province_name string")
    assert rows(house.provinces(names, [DAY])) == [("3", "north", 1, 10.5, 1)]

    alert = house.alerts_of([DAY]).orderBy("ts").collect()
    assert {a.mid for a in alert} == {"farm"} and {a.n_users for a in alert} == {3}
    assert len(alert) == 5
    people = house.alert_members_of([DAY]).where("kind = 'user'").select("value").distinct()
    assert rows(people) == [("u0",), ("u1",), ("u2",)]

    house.close_day(DAY)
    house.close_day(DAY)
    seen = spark.read.parquet(house.path("first_seen"))
    assert rows(seen.select("mid")) == [("a",), ("b",), ("c",), ("d",)]
    # what answers read of a closed day is its snapshot
    assert rows(house.orders_of([yesterday, DAY]).select("id", "total_amount")) == [("1", 10.5), ("2", 1.25)]
    assert rows(house.sales_of([DAY]).select("order_detail_id")) == [("1a",), ("1b",)]
    assert {r.mid for r in house.alerts_of([DAY]).collect()} == {"farm"} and house.devices_of([DAY]).count() == 3
    for frame in (house.orders_of([DAY]), house.sales_of([DAY]), house.devices_of([DAY])):
        files = frame.inputFiles()
        assert files and all("_folded/fold=" in f for f in files)
