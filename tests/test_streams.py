"""Streams give the batch result, over several batches, restarts and repeats."""

import json

import pytest
from oracle_check import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.functions.parse import good, parse_feed, with_log_time
from tidemart.operators import alerts, devices, orders, sales
from tidemart.schemas import ALERT_DOC, DAU_TABLE, FEEDS, ORDER_TABLE
from tidemart.sinks import tables
from tidemart.sources import feeds
from tidemart.streaming import jobs

BASE = 1_704_067_200_000


def timed(folder, spark):
    """A text feed whose arrival time is the ``rt`` second of each record."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(folder)
    return raw.select("value", F.timestamp_seconds(
        F.get_json_object("value", "$.rt").cast("long")).alias("timestamp"))


def start(mid, ts, **more):
    return json.dumps({"mid": mid, "ts": BASE + ts, "type": "startup", "rt": 1704067200, **more})


def dau_rows(spark, table):
    df = tables.read_days(spark, table, DAU_TABLE, "log_date")
    return rows(df.select("mid", "log_date", (F.col("ts") - BASE).alias("ts")))


def test_dau_first_batch_wins_and_restart_loses_nothing(spark, drop_file, tmp_path):
    table, progress = str(tmp_path / "dau"), str(tmp_path / "p")
    bad = str(tmp_path / "bad")

    def run(folder):
        jobs.start_dau(timed(folder, spark), table, progress, bad,
                       trigger=jobs.ONCE).awaitTermination()

    folder = drop_file("in", [start("a", 5000), start("a", 3000), start("b", 9000), "broken"])
    drop_file("in", [start("a", 1000), start("c", 100), start("a", 86_400_000)])
    run(folder)
    want = [("a", "2024-01-01", 3000), ("a", "2024-01-02", 86_400_000),
            ("b", "2024-01-01", 9000), ("c", "2024-01-01", 100)]
    assert dau_rows(spark, table) == want
    drop_file("in", [start("b", 1), start("d", 7), start("c", -1)])
    run(folder)
    run(folder)
    want = sorted(want + [("d", "2024-01-01", 7), ("c", "2023-12-31", -1)])
    assert dau_rows(spark, table) == want
    aside = spark.read.parquet(bad)
    assert rows(aside.select("value", "error")) == [("broken", "malformed")]


def test_dau_repeated_batch_changes_nothing(spark, drop_file, tmp_path):
    """A batch that was written but not yet committed runs again after a failure."""
    table, progress = str(tmp_path / "dau"), str(tmp_path / "p")
    folder = drop_file("in", [start("a", 5000), start("b", 1)])
    drop_file("in", [start("a", 1), start("c", 2)])
    jobs.start_dau(timed(folder, spark), table, progress, trigger=jobs.ONCE).awaitTermination()
    before = dau_rows(spark, table)
    commits = sorted((tmp_path / "p" / "commits").iterdir())
    for file in commits:
        if file.name.lstrip(".").startswith("1"):
            file.unlink()
    jobs.start_dau(timed(folder, spark), table, progress, trigger=jobs.ONCE).awaitTermination()
    assert dau_rows(spark, table) == before == [
        ("a", "2024-01-01", 5000), ("b", "2024-01-01", 1), ("c", "2024-01-01", 2)]


def test_dau_state_equals_batch(spark, drop_file, tmp_path):
    lines = [[start("a", 5000), start("b", 9000)], [start("a", 1000), start("c", 100)],
             [start("b", 86_400_005), start("a", 86_400_001)], [start("a", 500)]]
    for part in lines:
        folder = drop_file("in", part)
    table = str(tmp_path / "state")
    jobs.start_dau_state(timed(folder, spark), table, str(tmp_path / "p"),
                         trigger=jobs.ONCE).awaitTermination()
    got = jobs.active_devices(spark, table)
    raw = spark.createDataFrame([(x,) for part in lines for x in part], "value string")
    want = devices.active_days(with_log_time(good(parse_feed(raw, "start"))))
    assert rows(got.select("mid", "log_date", "first_et")) == rows(
        want.select("mid", "log_date", "first_et"))


def order(i, rt, amount="1.5", **more):
    return json.dumps({"id": i, "user_id": "u" + i, "total_amount": amount, "order_status": "n",
                       "create_time": "2024-01-01 04:05:06", "consignee_tel": "13812345678",
                       "rt": 1704067200 + rt, **more})


def detail(i, oid, rt):
    return json.dumps({"id": i, "order_id": oid, "sku_name": "ring", "sku_id": "s",
                       "order_price": "9.5", "rt": 1704067200 + rt})


def user(i, level, rt):
    return json.dumps({"id": i, "user_level": level, "birthday": "2000-01-01", "gender": "F",
                       "rt": 1704067200 + rt})


def test_gmv_last_version_and_one_day(spark, drop_file, tmp_path):
    folder = drop_file("in", [order("1", 0), order("2", 0), order("x", 0, "bad")])
    drop_file("in", [order("1", 50, "7.25"), order("2", -50, "99"),
                     order("3", 1, create_time="2024-01-02 00:00:00")])
    for period in ("day", "month"):
        table = str(tmp_path / period)
        jobs.start_gmv(timed(folder, spark), table, str(tmp_path / f"p-{period}"),
                       period=period, trigger=jobs.ONCE).awaitTermination()
        got = jobs.current_orders(spark, table, period=period)
        assert rows(got.select("id", "total_amount", "consignee_tel", "create_hour")) == [
            ("1", 7.25, "1381*******", "04"), ("2", 1.5, "1381*******", "04"),
            ("3", 1.5, "1381*******", "00")]
        one = jobs.current_orders(spark, table, ["2024-01-02"], period)
        assert rows(one.select("id")) == [("3",)]
        assert jobs.current_orders(spark, table, ["2023-05-05"], period).count() == 0
        assert rows(orders.gmv_total(got, "2024-01-01")) == [(8.75,)]
        read = orders.gmv_total(one, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
        assert ("ReadSchema: struct<id:string,total_amount:double,create_date:string,"
                "change_ts:timestamp,row_hash") in read


def test_publish_rebuilds_named_days_only(spark, drop_file, tmp_path):
    folder = drop_file("in", [order("1", 0), order("2", 0),
                              order("3", 1, create_time="2024-01-02 00:00:00")])
    table, target = str(tmp_path / "t"), str(tmp_path / "published")
    jobs.start_gmv(timed(folder, spark), table, str(tmp_path / "p"),
                   trigger=jobs.ONCE).awaitTermination()
    keep = ["id", "create_date"]

    def publish(days=None):
        tables.publish(spark, table, target, jobs.ORDER_VERSIONS, "create_date", keep,
                       ["change_ts"], days)
        return rows(spark.read.parquet(target).select("id", "total_amount"))

    assert publish() == [("1", 1.5), ("2", 1.5), ("3", 1.5)]
    drop_file("in", [order("1", 5, "4"), order("3", 5, "8", create_time="2024-01-02 00:00:00")])
    jobs.start_gmv(timed(folder, spark), table, str(tmp_path / "p"),
                   trigger=jobs.ONCE).awaitTermination()
    assert publish(["2024-01-02"]) == [("1", 1.5), ("2", 1.5), ("3", 8.0)]
    assert publish() == [("1", 4.0), ("2", 1.5), ("3", 8.0)]


def test_a_new_stream_does_not_overwrite_the_batches_of_an_old_one(spark, drop_file, tmp_path):
    table = str(tmp_path / "users")
    for n, level in enumerate(("1", "2")):
        folder = drop_file(f"in{n}", [user(f"u{n}", level, n), user("both", level, n)])
        jobs.start_users(timed(folder, spark), table, str(tmp_path / f"p{n}"),
                         trigger=jobs.ONCE).awaitTermination()
    assert rows(jobs.current_users(spark, table).select("id", "user_level")) == [
        ("both", "2"), ("u0", "1"), ("u1", "2")]


def run_sales(spark, tmp_path, name, order_folder, detail_folder, users, **more):
    table = str(tmp_path / name)
    jobs.start_sale_details(
        timed(order_folder, spark), timed(detail_folder, spark), users, table,
        str(tmp_path / f"p-{name}"), as_of="2024-06-01", trigger=jobs.ONCE,
        **more).awaitTermination()
    return jobs.current_sales(spark, table)


def test_sale_details_in_any_order_equal_the_batch_join(spark, drop_file, tmp_path):
    users = str(tmp_path / "users")
    folder = drop_file("users", [user("u1", "3", 0)])
    drop_file("users", [user("u1", "4", 10), user("u2", "5", 10)])
    jobs.start_users(timed(folder, spark), users, str(tmp_path / "p-users"),
                     trigger=jobs.ONCE).awaitTermination()
    order_files = [[order("1", 0), order("2", 5)], [order("3", 40)], [order("4", 90)]]
    detail_files = [[detail("a", "1", 0), detail("b", "3", 10), detail("c", "3", 11)],
                    [detail("d", "2", 60), detail("e", "9", 60), detail("f", "1", 99)],
                    [detail("g", "1", 100), detail("h", "1", 101), detail("i", "4", 95),
                     detail("j", None, 95)]]
    for part in order_files:
        order_folder = drop_file("orders", part)
    for part in detail_files:
        detail_folder = drop_file("details", part)
    as_raw = lambda parts: spark.createDataFrame(
        [(x,) for p in parts for x in p], "value string").withColumn(
        "rt", F.timestamp_seconds(F.get_json_object("value", "$.rt").cast("long")))

    def typed(parts, feed):
        raw = as_raw(parts).withColumnRenamed("rt", "timestamp")
        return good(parse_feed(raw, feed)).withColumnRenamed("timestamp", "rt")

    pairs = sales.interval_join(orders.clean_orders(typed(order_files, "order")),
                                typed(detail_files, "order_detail"))
    want = sales.enrich(pairs, jobs.current_users(spark, users), "2024-06-01")
    shown = ["order_detail_id", "order_id", "user_level", "user_age", "dt"]
    want = sorted(map(str, want.select(shown).collect()))
    assert len(want) == 7
    for salts in (1, 4):
        got = run_sales(spark, tmp_path, f"sales{salts}", order_folder, detail_folder, users,
                        salts=salts)
        assert sorted(map(str, got.select(shown).collect())) == want


def test_sale_details_survive_a_restart_between_order_and_line(spark, drop_file, tmp_path):
    users = str(tmp_path / "users")
    order_folder = drop_file("orders", [order("1", 0), order("2", 0)])
    detail_folder = drop_file("details", [detail("a", "1", 1), detail("w", "3", 20)])
    run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    drop_file("orders", [order("3", 50)])
    drop_file("details", [detail("b", "1", 60), detail("c", "2", 99)])
    run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    got = run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    assert rows(got.select("order_detail_id", "order_id", "user_age", "age_known")) == [
        ("a", "1", 0, False), ("b", "1", 0, False), ("c", "2", 0, False), ("w", "3", 0, False)]


def test_sale_details_that_come_out_of_order(spark, drop_file, tmp_path):
    """Pairs hours before all that was read so far, complete at once or over several batches."""
    users = str(tmp_path / "users")
    order_folder = drop_file("orders", [order("1", 90_000)])
    detail_folder = drop_file("details", [detail("a", "1", 90_001)])
    drop_file("orders", [order("2", 50), order("3", 86_390)])
    drop_file("details", [detail("b", "2", 60), detail("c", "4", 86_410), detail("d", "2", 151)])
    drop_file("orders", [order("4", 86_350), order("5", 10)])
    drop_file("details", [detail("e", "3", 86_490), detail("f", "1", 89_900), detail("g", "2", 0)])
    got = run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    assert rows(got.select("order_detail_id", "order_id")) == [
        ("a", "1"), ("b", "2"), ("c", "4"), ("e", "3"), ("f", "1"), ("g", "2")]
    drop_file("orders", [order("6", 500)])
    drop_file("details", [detail("h", "5", 20), detail("i", "6", 400)])
    got = run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    assert {r[0] for r in rows(got.select("order_detail_id"))} == set("abcefghi") and got.count() == 8


def test_alerts_survive_a_restart_inside_a_window(spark, drop_file, tmp_path):
    table = str(tmp_path / "alerts")

    def run(folder):
        jobs.start_alerts(timed(folder, spark), table, table + "-p", slide="5 minutes",
                          trigger=jobs.ONCE).awaitTermination()
        return rows(jobs.current_alerts(spark, table).select("mid", "n_users"))

    folder = drop_file("in", [event("m", "a", "coupon", 1, 10), event("m", "b", "coupon", 1, 20)])
    assert run(folder) == []
    drop_file("in", [event("m", "c", "coupon", 1, 30)])
    assert run(folder) == [("m", 3)]
    drop_file("in", [event("other", None, None, None, 90_000)])
    assert run(folder) == [("m", 3)]
    assert run(folder) == [("m", 3)]


def test_late_events_change_the_windows_they_belong_to(spark, drop_file, tmp_path):
    table = str(tmp_path / "alerts")

    def run(folder):
        jobs.start_alerts(timed(folder, spark), table, table + "-p", slide="5 minutes",
                          trigger=jobs.ONCE).awaitTermination()
        return rows(jobs.current_alerts(spark, table).select("mid", "n_users", "ts"))

    folder = drop_file("in", [event("now", u, "coupon", 1, 500_000) for u in "ab"])
    assert run(folder) == []
    drop_file("in", [event("late", u, "coupon", 1, 10) for u in "abcde"])
    alert = ("late", 5, BASE + 300_000)
    assert run(folder) == [alert]
    drop_file("in", [event("now", "c", "coupon", 1, 500_001)])
    end = BASE + (500_000 // 300 + 1) * 300_000
    assert run(folder) == [alert, ("now", 3, end)]
    drop_file("in", [event("late", "a", "clickItem", 1, 11)])  # a late click takes it back
    assert run(folder) == [("now", 3, end)]
    assert {r.doc_id for r in jobs.current_alert_members(spark, table).collect()} == {
        f"now-{end // 60000}"}


def test_folding_bounds_what_the_user_dimension_reads(spark, drop_file, tmp_path):
    table = str(tmp_path / "users")
    sizes = []
    for n in range(9):
        folder = drop_file("in", [user("1", f"v{n}", n), user(f"u{n % 3}", "x", n)])
        jobs.start_users(timed(folder, spark), table, table + "-p", trigger=jobs.ONCE).awaitTermination()
        want = rows(jobs.current_users(spark, table).select("id", "user_level", "login_name"))
        if n % 2:
            jobs.fold_users(spark, table)
            assert rows(jobs.current_users(spark, table).select("id", "user_level", "login_name")) == want
            sizes.append(len(jobs.user_versions(spark, table).inputFiles()))
            # a fold again, without new batches, is harmless
            jobs.fold_users(spark, table)
            assert rows(jobs.current_users(spark, table).select("id", "user_level", "login_name")) == want
    assert len(want) == 4 and len(spark.read.parquet(table).select("batch").distinct().collect()) <= 3
    assert max(sizes) <= sizes[0] + 2


def test_a_missing_table_or_a_wrong_period_is_an_error(spark, drop_file, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.current_orders(spark, str(tmp_path / "nowhere"))
    folder = drop_file("in", [""])
    table = str(tmp_path / "orders")
    jobs.start_gmv(timed(folder, spark), table, table + "-p", trigger=jobs.ONCE).awaitTermination()
    assert jobs.current_orders(spark, table).count() == 0
    line = json.dumps({"id": "1", "create_time": "2024-01-01 00:00:00", "total_amount": "1",
                       "rt": 1704067200})
    drop_file("in", [line])
    jobs.start_gmv(timed(folder, spark), table, table + "-p", period="month",
                   trigger=jobs.ONCE).awaitTermination()
    assert jobs.current_orders(spark, table, period="month").count() == 1
    with pytest.raises(ValueError):
        jobs.current_orders(spark, table)


def event(mid, uid, evid, item, s):
    return json.dumps({"mid": mid, "uid": uid, "evid": evid, "itemid": item,
                       "ts": BASE + s * 1000, "rt": 1704067200 + s})


def test_alerts_over_batches_equal_the_batch_alerts(spark, drop_file, tmp_path):
    import random
    rng = random.Random(11)
    names = ["coupon"] * 8 + ["addCart", "clickItem"]
    data = sorted(rng.randrange(1800) for _ in range(150))
    lines = [event(f"m{rng.randrange(5)}", rng.choice("abcd"), rng.choice(names),
                   rng.randrange(4), s) for s in data]
    for n in range(0, 150, 50):
        part = lines[n:n + 50]
        rng.shuffle(part)
        folder = drop_file("in", part)
    folder = drop_file("in", [event("closing", None, None, None, 90_000)])
    for slide in ("1 minute", "30 seconds"):
        table = str(tmp_path / f"alerts-{slide[:2].strip()}")
        jobs.start_alerts(timed(folder, spark), table, table + "-p", slide=slide,
                          trigger=jobs.ONCE).awaitTermination()
        raw = spark.createDataFrame([(x,) for x in lines], "value string")
        counted = alerts.windowed(with_log_time(good(parse_feed(raw, "event"))), slide=slide)
        want = alerts.alert_documents(alerts.detect(counted))
        got = jobs.current_alerts(spark, table)
        columns = ALERT_DOC.fieldNames()
        assert want.count() > 3
        assert sorted(map(str, got.select(columns).collect())) == sorted(
            map(str, want.select(columns).collect()))


def test_routers_feed_the_typed_feeds(spark, drop_file, tmp_path):
    topics, archive = str(tmp_path / "topics"), str(tmp_path / "archive")
    folder = drop_file("in", ['{"type":"startup","mid":"a","rt":1704067200}',
                              '{"type":"event","mid":"a","evid":"coupon","rt":1704067200}'])
    drop_file("in", ['{"mid":"b","rt":1704153600}', "oops"])
    bad = str(tmp_path / "bad")
    raw = timed(folder, spark).withColumn(
        "timestamp", F.coalesce("timestamp", F.lit("2024-01-02").cast("timestamp")))
    jobs.start_log_router(raw, topics, archive, str(tmp_path / "p"), bad,
                          trigger=jobs.ONCE).awaitTermination()
    starts = good(parse_feed(feeds.read_topic(spark, topics, FEEDS["start"].topic), "start"))
    assert rows(starts.select("mid", "ts")) == [("a", BASE)]
    seen = feeds.read_topic_stream(spark, topics, FEEDS["event"].topic)
    out = str(tmp_path / "out")
    (good(parse_feed(seen, "event")).select("mid").writeStream.format("parquet")
     .option("checkpointLocation", out + "-p").trigger(availableNow=True).start(out)
     .awaitTermination())
    assert rows(spark.read.parquet(out)) == [("a",), ("b",)]
    kept = spark.read.parquet(archive).groupBy("period").count()
    assert {str(r["period"]): r["count"] for r in kept.collect()} == {
        "2024-01-01": 2, "2024-01-02": 2}
    assert rows(spark.read.parquet(bad).select("value")) == [("oops",)]


def test_changes_from_json_files(spark, drop_file, tmp_path):
    lines = [json.dumps({"entry_type": "ROWDATA", "table": t, "op": o,
                         "ts": "2024-01-01T00:00:00Z", "after": {"id": str(n)}})
             for n, (t, o) in enumerate([("user_info", "UPDATE"), ("user_info", "DELETE"),
                                         ("order_info", "INSERT"), ("other", "INSERT")])]
    folder = drop_file("in", lines[:2])
    drop_file("in", lines[2:])
    topics = str(tmp_path / "topics")
    jobs.start_change_router(feeds.read_changes_stream(spark, folder, max_files=1), topics,
                             str(tmp_path / "p"), trigger=jobs.ONCE).awaitTermination()
    got = spark.read.parquet(topics).select("topic", "value", "batch")
    assert rows(got) == [("TOPIC_ORDER_INFO", '{"id":"2"}', 1), ("TOPIC_USER_INFO", '{"id":"0"}', 0)]
    assert feeds.read_changes(spark, folder).count() == 4


def test_unreadable_records_of_any_feed_are_kept(spark, drop_file, tmp_path):
    folder = drop_file("in", [detail("a", "1", 0), '{"id":"b","rt":1704067200}'])
    drop_file("in", ['{"id":"c","order_id":"1","order_price":"x","rt":1704153600}'])
    out = str(tmp_path / "out")
    jobs.start_quarantine(timed(folder, spark), "order_detail", str(tmp_path / "p"), out,
                          trigger=jobs.ONCE).awaitTermination()
    assert rows(spark.read.parquet(out).select("day", "error")) == [
        ("2024-01-01", "missing order_id"), ("2024-01-02", "bad order_price")]


def test_feeds_read_as_stream_and_as_batch(spark, drop_file, tmp_path):
    folder = drop_file("in", [user("1", "a", 0)])
    batch = feeds.read_feed(spark, "user", "text", folder)
    assert batch.columns == ["value", "timestamp"] and batch.count() == 1
    stream = feeds.read_feed_stream(spark, "user", "text", folder)
    assert stream.isStreaming and stream.columns == ["value", "timestamp"]


def test_empty_input(spark, tmp_path, drop_file):
    folder = drop_file("in", [""])
    for name, job in (("dau", jobs.start_dau), ("gmv", jobs.start_gmv)):
        job(timed(folder, spark), str(tmp_path / name), str(tmp_path / f"p-{name}"),
            trigger=jobs.ONCE).awaitTermination()
    assert dau_rows(spark, str(tmp_path / "dau")) == []
    assert jobs.current_orders(spark, str(tmp_path / "gmv")).count() == 0
    assert set(ORDER_TABLE.fieldNames()) <= set(
        jobs.current_orders(spark, str(tmp_path / "gmv")).columns)


def test_readers_open_only_committed_folders_of_their_days(spark, tmp_path, monkeypatch):
    """With a thousand old days, a read lists the log of its own days and nothing else."""
    table = str(tmp_path / "t")
    layout = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.StringType())])

    def write(batch, *days):
        tables.write_days(spark.createDataFrame([(batch, d) for d in days], layout), table, "day", "r", batch)

    write(0, "2024-01-01", "2024-01-02")
    write(1, "2024-01-02")
    for n in range(1000):  # old days, whose folders are not there at all: opening one would fail
        day = f"{1000 + n}-05-05"
        (tmp_path / "t" / "_commits" / f"period={day}").mkdir()
        (tmp_path / "t" / "_commits" / f"period={day}" / "r.000000000009").touch()
    left = tmp_path / "t" / "run=r" / "batch=7" / "period=2024-01-02"  # of a batch that failed
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_text("half a file")
    listed = []
    names = tables._names
    monkeypatch.setattr(tables, "_names", lambda s, path: listed.append(path) or names(s, path))
    got = tables.read_days(spark, table, layout, "day", ["2024-01-02", "2023-07-07"])
    assert rows(got) == [(0, "2024-01-02", "r", 0), (1, "2024-01-02", "r", 1)]
    assert len(listed) == 2 and all("period=20" in path for path in listed)
    write(1, "2024-01-03")  # the batch again, with another day
    assert rows(tables.read_days(spark, table, layout, "day", ["2024-01-02", "2024-01-03"])) == [
        (0, "2024-01-02", "r", 0), (1, "2024-01-03", "r", 1)]


def test_a_batch_reads_its_own_days_however_far_apart(spark, drop_file, tmp_path, monkeypatch):
    table, asked = str(tmp_path / "dau"), []
    read = tables.read_days
    monkeypatch.setattr(tables, "read_days", lambda s, p, layout, day, days=None, period="day": (
        asked.append(days), read(s, p, layout, day, days, period))[1])
    folder = drop_file("in", [start("a", 1000), start("b", -BASE + 5)])
    jobs.start_dau(timed(folder, spark), table, table + "-p", trigger=jobs.ONCE).awaitTermination()
    assert asked == [["1970-01-01", "2024-01-01"]]
    asked.clear()
    folder = drop_file("events", [event("m", u, "coupon", 1, 10) for u in "abc"]
                       + [event("old", "a", "coupon", 1, -BASE // 1000 + 86_400)])
    alert_table = str(tmp_path / "alerts")
    jobs.start_alerts(timed(folder, spark), alert_table, alert_table + "-p", slide="5 minutes",
                      trigger=jobs.ONCE).awaitTermination()
    assert asked == [["1970-01-01", "1970-01-02", "2023-12-31", "2024-01-01"]]
    assert rows(jobs.current_alerts(spark, alert_table).select("mid", "n_users")) == [("m", 3)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_alerts_in_any_zone(spark, drop_file, tmp_path, monkeypatch, zone):
    """Small batches across midnight, with driver and session in another zone."""
    import os
    import time
    table = str(tmp_path / "alerts")
    folder = None
    for s, users in ((3 * 3600, "abcde"), (86_399, "ab"), (86_401, "cde"), (28_799, "abcde")):
        folder = drop_file("in", [event(f"m{s // 1000}", u, "coupon", 1, s) for u in users])
    before = spark.conf.get("spark.sql.session.timeZone")
    monkeypatch.setitem(os.environ, "TZ", zone)
    try:
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", zone)
        jobs.start_alerts(timed(folder, spark), table, table + "-p",
                          trigger=jobs.ONCE).awaitTermination()
        got = {(r["mid"], r["n_users"]) for r in jobs.current_alerts(spark, table).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        monkeypatch.undo()
        time.tzset()
    assert got == {("m10", 5), ("m28", 5), ("m86", 5), ("m86", 3)}


def test_folded_days_answer_as_before(spark, drop_file, tmp_path):
    """Folds beside the stream: between batches, again, and with a batch that is repeated after it."""
    table, progress = str(tmp_path / "orders"), str(tmp_path / "p")

    def run(folder):
        jobs.start_gmv(timed(folder, spark), table, progress, trigger=jobs.ONCE).awaitTermination()
        return rows(jobs.current_orders(spark, table).select("id", "create_date", "total_amount"))

    def fold(days=None):
        tables.fold_days(spark, table, jobs.ORDER_VERSIONS, "create_date", days, ["id", "create_date"], ["change_ts"])
        return rows(jobs.current_orders(spark, table).select("id", "create_date", "total_amount"))

    want, folders = [], []
    for n in range(6):
        folder = drop_file("in", [order("1", n, str(n)), order(f"x{n}", n, "1"),
                                  order("2", -n, str(n), create_time="2024-01-02 00:00:00")])
        want = run(folder)
        assert fold(["2024-01-01"] if n % 2 else None) == want
        folders.append(len(list((tmp_path / "orders").glob("run=*/batch=*"))))
    assert want[0] == ("1", "2024-01-01", 5.0) and ("2", "2024-01-02", 0.0) in want
    assert max(folders) <= 3 and fold() == want == fold()
    for file in (tmp_path / "p" / "commits").iterdir():  # the last batch runs again, after its fold
        if file.name.lstrip(".").startswith("5"):
            file.unlink()
    assert run(folder) == want == fold()
    one = jobs.current_orders(spark, table, ["2024-01-02"])
    assert len(one.inputFiles()) <= 2 and rows(one.select("id")) == [("2",)]


def test_closed_receive_days_keep_late_rows_for_a_replay(spark, drop_file, tmp_path):
    users = str(tmp_path / "users")
    order_folder = drop_file("orders", [order("1", 86_390), order("2", 100)])
    detail_folder = drop_file("details", [detail("a", "1", 86_395), detail("b", "9", 50)])
    for n in (1, 2):
        drop_file("orders", [order(f"n{n}", 90_000 + n)])
        drop_file("details", [detail(f"m{n}", f"n{n}", 90_000 + n)])
    got = run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    table = str(tmp_path / "s")
    jobs.close_feeds(spark, table, "2024-01-02")
    jobs.close_feeds(spark, table, "2024-01-02")
    held = tables.committed(spark, f"{table}_feeds/orders")
    assert held["2024-01-01"].batches == [] and held["2024-01-02"].batches
    # late for the closed day: "b" has its order now, "c" its line; a line of the open day meets a closed one
    drop_file("orders", [order("9", 60), order("8", 70_000)])
    drop_file("details", [detail("c", "2", 120), detail("e", "1", 86_450), detail("d", "8", 70_001)])
    got = run_sales(spark, tmp_path, "s", order_folder, detail_folder, users)
    assert rows(got.select("order_detail_id")) == [("a",), ("e",), ("m1",), ("m2",)]
    assert rows(jobs.late_rows(spark, table)) == [("2024-01-01", "order", 2), ("2024-01-01", "order_detail", 2)]
    for _ in range(2):
        jobs.replay_late(spark, table, users, as_of="2024-06-01")
        got = jobs.current_sales(spark, table)
        assert rows(got.select("order_detail_id", "order_id")) == [
            ("a", "1"), ("b", "9"), ("c", "2"), ("d", "8"), ("e", "1"), ("m1", "n1"), ("m2", "n2")]


def test_first_seen_is_corrected_by_late_records(spark, drop_file, tmp_path):
    table, day = str(tmp_path / "first"), 86_400_000

    def run(folder):
        jobs.start_first_seen(timed(folder, spark), table, table + "-p", trigger=jobs.ONCE).awaitTermination()
        return rows(jobs.new_devices_of(spark, table))

    folder = drop_file("in", [start("a", 5 * day), start("b", 5 * day + 1), start("a", 6 * day)])
    assert run(folder) == [("2024-01-06", "00", 2)]
    drop_file("in", [start("a", 7 * day), start("c", 7 * day)])
    assert run(folder) == [("2024-01-06", "00", 2), ("2024-01-08", "00", 1)]
    jobs.fold_first_seen(spark, table)
    drop_file("in", [start("a", 3_600_000), start("b", 5 * day)])  # a moves to another day, b to itself
    want = [("2024-01-01", "01", 1), ("2024-01-06", "00", 1), ("2024-01-08", "00", 1)]
    assert run(folder) == want
    jobs.fold_first_seen(spark, table)
    assert run(folder) == want and rows(jobs.first_seen(spark, table).select("mid")) == [("a",), ("b",), ("c",)]
    assert rows(jobs.new_devices_of(spark, table, ["2024-01-06"])) == [("2024-01-06", "00", 1)]
