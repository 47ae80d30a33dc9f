import json

import pytest
from oracle_check import rows
from pyspark.sql import functions as F

from tidemart.operators import alerts, devices, dimension, orders, routing, sales, search, serving
from tidemart.schemas import SALE_DETAIL

BASE = 1_704_067_200_000


# --- devices --------------------------------------------------------------------

def logs(spark, *data):
    from tidemart.functions.parse import with_log_time
    return with_log_time(spark.createDataFrame(
        [(m, BASE + ts, i) for i, (m, ts) in enumerate(data)], "mid string, ts long, n int"))


def test_first_of_day_by_time_and_day(spark):
    day = 86_400_000
    df = logs(spark, ("a", 500), ("a", 100), ("b", 100), ("b", 100), ("a", day + 9),
              ("a", -1000), (None, 5))
    assert rows(devices.first_of_day(df, "n").select("mid", "log_date", "n")) == [
        ("a", "2023-12-31", 5), ("a", "2024-01-01", 1), ("a", "2024-01-02", 4),
        ("b", "2024-01-01", 2)]


def test_first_of_day_is_stable_without_a_tie_column(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "mid string, uid string")
    df = df.withColumns({"ts": F.lit(5), "log_date": F.lit("d")})
    once = devices.first_of_day(df).collect()
    assert all(devices.first_of_day(df.repartition(n)).collect() == once for n in (1, 2, 3))


def test_seen_devices_are_dropped_per_day(spark):
    firsts = devices.first_of_day(logs(spark, ("a", 1), ("b", 2), ("a", 86_400_000)))
    seen = spark.createDataFrame([("a", "2024-01-01"), ("z", "2024-01-01")],
                                 "mid string, log_date string")
    assert rows(devices.drop_seen(firsts, seen).select("mid", "log_date")) == [
        ("a", "2024-01-02"), ("b", "2024-01-01")]
    none = seen.limit(0)
    assert devices.drop_seen(firsts, none).count() == 3


def test_new_devices_count_once(spark):
    days = devices.active_days(logs(spark, ("a", 1), ("a", 86_400_001), ("b", 86_400_002)))
    assert rows(devices.new_devices_by_day(days)) == [("2024-01-01", 1), ("2024-01-02", 1)]
    assert rows(devices.new_devices(days).select("mid", "log_hour")) == [("a", "00"), ("b", "00")]


# --- order value and serving ----------------------------------------------------

def order_rows(spark, *data):
    return spark.createDataFrame(list(data), "create_date string, create_hour string, "
                                             "total_amount double")


def test_total_of_a_day_without_orders_is_null(spark):
    df = order_rows(spark, ("2024-01-01", "03", 1.1), ("2024-01-01", "04", 2.2))
    assert rows(orders.gmv_total(df, "2024-01-01")) == [(3.3,)]
    assert rows(orders.gmv_total(df, "2024-01-02")) == [(None,)]


def test_comparison_fills_hours_and_crosses_months(spark):
    dau = spark.createDataFrame(
        [("2024-02-29", "23"), ("2024-03-01", "00"), ("2024-03-01", "00"), ("2024-03-02", "01")],
        "log_date string, log_hour string")
    money = order_rows(spark, ("2024-03-01", "05", 2.5), ("2024-02-29", "05", 1.0))
    tables = {"dau": dau, "new_mids": dau, "orders": money}
    got = {r.hour: (r.yesterday, r.today)
           for r in serving.metric_hours(spark, "dau", "2024-03-01", **tables).collect()}
    assert len(got) == 24 and got["00"] == (0.0, 2.0) and got["23"] == (1.0, 0.0)
    assert got["12"] == (0.0, 0.0)
    money_hours = serving.metric_hours(spark, "order_amount", "2024-03-01", **tables)
    assert rows(money_hours.where("today > 0")) == [("05", 1.0, 2.5)]
    assert serving.metric_hours(spark, "other", "2024-03-01", **tables).count() == 0


def test_payloads(spark):
    dau = spark.createDataFrame([("2024-03-01", "07"), ("2024-02-29", "07")],
                                "log_date string, log_hour string")
    money = order_rows(spark, ("2024-03-01", "05", 2.5))
    card = serving.totals_card(dau, dau, money, "2024-03-01")
    answer = json.loads(serving.totals_payload(card).first()[0])
    assert [(e["id"], e["value"]) for e in answer] == [
        ("dau", 1.0), ("new_mid", 1.0), ("order_amount", 2.5)]
    hours = serving.metric_rows("order_amount", "2024-03-01", dau=dau, new_mids=dau, orders=money)
    assert json.loads(serving.hours_payload(hours).first()[0]) == {
        "yesterday": {}, "today": {"05": 2.5}}


def test_last_write_per_order(spark):
    df = spark.createDataFrame(
        [("1", 5.0, 1), ("1", 7.0, 3), ("1", 6.0, 2), ("2", 1.0, 1), (None, 1.0, 9)],
        "id string, total_amount double, change_ts int")
    assert rows(orders.last_write(df).select("id", "total_amount")) == [("1", 7.0), ("2", 1.0)]


def test_provinces_are_classed_with_an_open_top(spark):
    df = spark.createDataFrame([("u1", 1.0)] * 100 + [("u2", 1.0)] * 700 + [("u3", 2.0)],
                               "user_id string, total_amount double")
    users = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "id string, province_id int")
    names = spark.createDataFrame([(1, "p1"), (2, "p2")], "province_id int, province_name string")
    got = orders.sales_by_province(df, users, names)
    assert {tuple(r) for r in got.collect()} == {
        (1, "p1", 100, 100.0, 2), (2, "p2", 700, 700.0, 6), (3, None, 1, 2.0, 1)}
    direct = orders.order_sales_by_province(df.join(users, df.user_id == users.id), names)
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in got.collect()}


# --- sale details ---------------------------------------------------------------

def heads(spark, *data):
    return spark.createDataFrame(
        [(i, "new", "2024-01-01 01:02:03", u, "2024-01-01", rt) for i, u, rt in data],
        "id string, order_status string, create_time string, user_id string, "
        "create_date string, rt long").withColumn("rt", F.timestamp_seconds("rt"))


def lines(spark, *data):
    return spark.createDataFrame(
        [(d, o, "s", "9.5", "ring", rt) for d, o, rt in data],
        "id string, order_id string, sku_id string, order_price string, sku_name string, "
        "rt long").withColumn("rt", F.timestamp_seconds("rt"))


def test_interval_bound_is_inclusive_on_both_sides(spark):
    order_df = heads(spark, ("1", "u", 1000))
    gaps = [-101, -100, -99, 0, 99, 100, 101]
    detail_df = lines(spark, *[(str(g), "1", 1000 + g) for g in gaps], ("n", None, 1000),
                      ("other", "2", 1000))
    for salts in (1, 3):
        got = sales.interval_join(order_df, detail_df, salts=salts)
        assert {r.order_detail_id for r in got.collect()} == {str(g) for g in gaps[1:-1]}
        assert got.count() == 5


def test_interval_join_equals_brute_force(spark):
    import random
    rng = random.Random(3)
    order_data = [(str(rng.randrange(40)), "u", rng.randrange(600)) for _ in range(60)]
    detail_data = [(f"d{i}", str(rng.randrange(45)), rng.randrange(600)) for i in range(300)]
    want = sorted((d, o, max(a, b)) for o, _, a in order_data for d, oid, b in detail_data
                  if o == oid and abs(a - b) <= 100)
    got = sales.interval_join(heads(spark, *order_data), lines(spark, *detail_data), salts=2)
    assert len(want) > 50
    assert rows(got.select("order_detail_id", "order_id",
                           F.unix_seconds("joined_rt").alias("at"))) == want


def test_first_and_last_rows_equal_brute_force(spark):
    import random
    from tidemart.operators.keyed import first_per_key, last_per_key
    rng = random.Random(4)
    data = [(rng.choice("abc") if i % 3 else "hot", rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, n int").repartition(7)
    for pick, best in ((first_per_key, min), (last_per_key, max)):
        got = pick(df, ["k"], "t", "n")
        want = sorted(best((d for d in data if d[0] == k), key=lambda d: d[1:])
                      for k in {d[0] for d in data})
        assert rows(got) == want


def test_full_outer_matches_the_engine_and_a_hot_order(spark):
    order_df = heads(spark, *[(str(i), "u", 0) for i in range(20)], (None, "u", 0))
    detail_df = lines(spark, *[(f"h{i}", "3", 0) for i in range(3000)],
                      *[(f"d{i}", str(i), 0) for i in range(10, 30)], ("n", None, 0))
    got = sales.full_outer_lines(order_df, detail_df)
    want = sales.order_side(order_df).join(sales.detail_side(detail_df), "order_id", "full")
    columns = ["order_id", "order_detail_id", "order_status", "sku_price"]
    key = F.concat_ws("|", *columns)
    assert rows(got.select(key)) == rows(want.select(key))
    sides = {r["side"]: r["count"] for r in got.groupBy("side").count().collect()}
    assert sides == {"both": 3010, "order_only": 9, "detail_only": 10}


def test_unknown_user_keeps_the_row(spark):
    order_df = heads(spark, ("1", "u1", 0), ("2", "u2", 0), ("3", None, 0))
    detail_df = lines(spark, ("a", "1", 0), ("b", "2", 0), ("c", "3", 0), ("d", "9", 0))
    users = spark.createDataFrame([("u1", "7", "2000-01-01", "F"), ("u9", "1", None, "M")],
                                  "id string, user_level string, birthday string, gender string")
    got = sales.enriched_sale_details(order_df, detail_df, users, "2024-06-01")
    assert got.columns == SALE_DETAIL.fieldNames()
    picked = got.select("order_detail_id", "user_gender", "user_age", "user_level", "sku_price",
                        "age_known")
    assert sorted(map(tuple, picked.collect())) == [
        ("a", "F", 24, "7", 9.5, True), ("b", None, 0, None, 9.5, False),
        ("c", None, 0, None, 9.5, False)]
    late = sales.join_lines(order_df, detail_df)
    again = sales.enrich(late, sales.users_of(late, users), "2024-06-01")
    assert sorted(map(str, again.select(got.columns).collect())) == sorted(map(str, got.collect()))


def test_latest_user_by_change_time(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 1), (None, "x", 1)],
                               "id string, user_level string, change_ts int")
    assert rows(dimension.latest_users(df).select("id", "user_level")) == [("1", "b"), ("2", "c")]


# --- search ---------------------------------------------------------------------

def sale_rows(spark):
    data = [(f"d{i:02d}", f"o{i // 2:02d}", "F" if i % 3 else "M", 15 + i, str(i % 2),
             "Red Ring" if i % 2 else "bolt", i < 20, f"2024-01-{1 + i % 5:02d}")
            for i in range(24)]
    df = spark.createDataFrame(data, "order_detail_id string, order_id string, user_gender string,"
                               "user_age int, user_level string, sku_name string,"
                               "age_known boolean, dt string")
    return df.withColumn("user_gender", F.when(F.col("age_known"), F.col("user_gender")))


def test_search_parts_agree(spark):
    df = sale_rows(spark)
    found = search.search(df, keyword="rING", page=1, size=5)
    assert rows(found.total) == [(12,)]
    ages = {r.name: r.value for r in found.age.collect()}
    # odd i below 20: ages 16, 18 | 20, 22, 24, 26, 28, 30 | 32, 34; two unknown
    assert ages == {"20岁以下": 2, "20-30岁": 6, "30岁以上": 2, "unknown": 2}
    assert sum(r.value for r in found.gender.collect()) == 12
    assert abs(sum(r.share_pct for r in found.gender.collect()) - 100) < 1e-9
    whole = search.filter_sales(df, keyword="ring").orderBy(*search.PAGE_ORDER).collect()
    assert found.detail.collect() == whole[:5]
    answer = json.loads(search.response(found).first()[0])
    assert answer["total"] == 12 and len(answer["stat"]) == 2
    assert [d["order_detail_id"] for d in answer["detail"]] == [
        r.order_detail_id for r in whole[:5]]


def test_empty_search_and_optional_filters(spark):
    df = sale_rows(spark)
    nothing = search.search(df, keyword="zzz")
    assert rows(nothing.total) == [(0,)] and nothing.detail.count() == 0
    assert json.loads(search.response(nothing).first()[0]) == {
        "total": 0, "stat": [{"options": []}, {"options": []}], "detail": []}
    assert search.filter_sales(df).count() == 24
    assert search.filter_sales(df, keyword="").count() == 24
    assert search.filter_sales(df, day="2024-01-02", level="1").count() == 3


def test_reading_on_from_a_row_equals_pages(spark):
    df = sale_rows(spark)
    pages = [search.page_of(df, n, 7).collect() for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [7, 7, 7, 3]
    last = tuple(pages[0][-1][c] for c in search.PAGE_ORDER)
    assert search.page_after(df, last, 7).collect() == pages[1]


# --- alerts ---------------------------------------------------------------------

def events(spark, *data):
    df = spark.createDataFrame([(m, u, e, i, BASE + s * 1000) for m, u, e, i, s in data],
                               "mid string, uid string, evid string, itemid string, ts long")
    return df.withColumn("et", F.timestamp_millis("ts"))


def brute_alerts(data, length, slide, users=3):
    """The rule, window by window, in plain Python."""
    found = {}
    starts = {s - s % slide - k * slide for *_, s in data for k in range(length // slide)}
    for start in starts:
        inside = [d for d in data if start <= d[4] < start + length]
        for mid in {d[0] for d in inside if d[0] is not None}:
            mine = [d for d in inside if d[0] == mid]
            coupons = [d for d in mine if d[2] == "coupon"]
            people = {d[1] for d in coupons if d[1] is not None}
            if len(people) >= users and not any(d[2] == "clickItem" for d in mine):
                found[mid, (BASE // 1000 + start + length) * 1000] = (
                    sorted(people), sorted({d[3] for d in coupons if d[3] is not None}),
                    sorted(d[2] for d in mine if d[2] is not None))
    return found


def listed(counted):
    """(users, items, event names) of each alert, from its member rows."""
    found = alerts.detect(counted)
    heads = {r.doc_id: (r.mid, r.ts) for r in alerts.alert_documents(found).collect()}
    out = {key: ([], [], []) for key in heads.values()}
    for r in alerts.alert_members(counted, found).orderBy("value").collect():
        place = out[heads[r.doc_id]][("user", "item", "event").index(r.kind)]
        place.extend([r.value] * (r.n if r.kind == "event" else 1))
    return out


def test_two_three_and_four_users_click_and_null_user(spark):
    data = [("two", "a", "coupon", "1", 0), ("two", "b", "coupon", "1", 1),
            ("two", None, "coupon", "1", 1), ("two", "b", "coupon", "2", 2),
            ("three", "a", "coupon", "1", 0), ("three", "b", "coupon", "1", 1),
            ("three", "c", "coupon", "2", 2), ("three", "c", "addCart", "9", 3),
            ("four", "a", "coupon", "1", 0), ("four", "b", "coupon", "1", 1),
            ("four", "c", "coupon", "2", 2), ("four", "d", "coupon", "2", 3),
            ("four", "d", "clickItem", "2", 4),
            ("apart", "a", "coupon", "1", 0), ("apart", "b", "coupon", "1", 299),
            ("apart", "c", "coupon", "1", 301),
            (None, "a", "coupon", "1", 0), (None, "b", "coupon", "1", 0),
            (None, "c", "coupon", "1", 0)]
    counted = alerts.windowed(events(spark, *data))
    got = listed(counted)
    assert got == brute_alerts(data, 300, 60)
    assert ("three", BASE + 300_000) in got and ("four", BASE + 300_000) not in got
    assert {m for m, _ in got} == {"three"}


def test_alerts_equal_brute_force_on_random_events(spark):
    import random
    rng = random.Random(5)
    names = ["coupon"] * 8 + ["addCart", "clickItem"]
    data = [(f"m{rng.randrange(6)}", rng.choice(["a", "b", "c", "d", None]), rng.choice(names),
             str(rng.randrange(4)), rng.randrange(3600)) for _ in range(220)]
    counted = alerts.windowed(events(spark, *data))
    docs = alerts.alert_documents(alerts.detect(counted)).collect()
    got = listed(counted)
    want = brute_alerts(data, 300, 60)
    assert want and got == want
    assert len({r.doc_id for r in docs}) == len(docs)


def test_fine_slide_keeps_the_last_alert_of_each_minute(spark):
    data = [("m", u, "coupon", u, s) for u, s in (("a", 0), ("b", 10), ("c", 31))]
    counted = alerts.windowed(events(spark, *data), slide="5 seconds")
    docs = alerts.alert_documents(alerts.detect(counted)).collect()
    every = brute_alerts(data, 300, 5)
    last = {}
    for mid, ts in every:
        last[ts // 60000] = max(ts, last.get(ts // 60000, 0))
    assert {r.ts for r in docs} == set(last.values())
    assert all(r.doc_id == f"m-{r.ts // 60000}" for r in docs)


@pytest.mark.parametrize("size", [10_000, 10_001])
def test_an_alert_has_one_shape_at_every_size(spark, size):
    frame = spark.range(size).select(
        F.lit("hot").alias("mid"), (F.col("id") % 5).cast("string").alias("uid"),
        F.lit("coupon").alias("evid"), F.lit("i").alias("itemid"),
        F.timestamp_millis(F.lit(BASE) + F.col("id") % 60_000).alias("et"))
    counted = alerts.windowed(frame, slide="5 minutes")
    found = alerts.detect(counted)
    head = alerts.alert_documents(found).collect()
    assert [(h.n_users, h.n_items, h.n_events) for h in head] == [(5, 1, size)]
    listed = alerts.alert_members(counted, found).collect()
    assert {(m.kind, m.value) for m in listed} == {
        *(("user", str(i)) for i in range(5)), ("item", "i"), ("event", "coupon")}
    assert all(sum(m.n for m in listed if m.kind == k) == size for k in ("user", "item", "event"))


def test_panes_where_the_slide_does_not_divide_the_window(spark):
    import random
    rng = random.Random(6)
    data = [(f"m{rng.randrange(4)}", rng.choice("abcd"), rng.choice(["coupon"] * 6 + ["clickItem"]),
             str(rng.randrange(4)), rng.randrange(1800)) for _ in range(150)]
    counted = alerts.windowed(events(spark, *data), "5 minutes", "2 minutes")
    got = {(r.mid, int(r.ms)): r.n_users for r in alerts.detect(counted).select(
        "mid", F.unix_millis("window_end").alias("ms"), "n_users").collect()}
    assert got == {k: len(v[0]) for k, v in brute_alerts(data, 300, 120).items()} and got


# --- routing --------------------------------------------------------------------

def test_log_routing(spark):
    df = spark.createDataFrame(
        [('{"type":"startup"}',), ('{"type":"event"}',), ('{"x":1}',), ('{"type":null}',),
         ("oops",), ('{"type":"startup"',)], "value string").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {(r.topic, r.error): r.n for r in routing.route_logs(df).groupBy("topic", "error")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {("Topic_Start", None): 1, ("Topic_Event", None): 3, (None, "malformed"): 2}


def test_change_routing(spark):
    data = [(e, t, o, {"id": str(n), "v": None}) for n, (e, t, o) in enumerate([
        ("ROWDATA", "order_info", "INSERT"), ("ROWDATA", "order_info", "UPDATE"),
        ("ROWDATA", "order_info", "DELETE"), ("ROWDATA", "order_detail", "INSERT"),
        ("ROWDATA", "order_detail", "UPDATE"), ("ROWDATA", "user_info", "INSERT"),
        ("ROWDATA", "user_info", "UPDATE"), ("ROWDATA", "user_info", "DELETE"),
        ("ROWDATA", "sku_info", "INSERT"), ("TRANSACTIONEND", "order_info", "INSERT"),
        (None, "order_info", "INSERT"), ("ROWDATA", None, "INSERT")])]
    df = spark.createDataFrame(
        data, "entry_type string, table string, op string, after map<string,string>").withColumn(
        "ts", F.current_timestamp())
    got = {(r.topic, json.loads(r.value)["id"]) for r in routing.route_changes(df).collect()}
    assert got == {("TOPIC_ORDER_INFO", "0"), ("TOPIC_ORDER_DETAIL", "3"),
                   ("TOPIC_USER_INFO", "5"), ("TOPIC_USER_INFO", "6")}


def test_alert_events_in_order_equal_a_plain_list(spark):
    import random
    rng = random.Random(3)
    base = 1_704_067_200
    data = [(n, f"m{rng.randrange(3)}", rng.choice("abcd"), rng.choice(["coupon"] * 4 + ["addCart", None]), "i",
             1000 * (base + rng.randrange(1500))) for n in range(300)]
    rows_of = spark.createDataFrame(data, "id long, mid string, uid string, evid string, itemid string, ts long")
    events = rows_of.withColumn("et", F.timestamp_millis("ts"))
    found = alerts.detect(alerts.windowed(events))
    got = sorted(tuple(r) for r in alerts.alert_events(events, found).collect())
    want = []
    for w in alerts.last_of_minute(found).select("mid", F.unix_millis("window_end").alias("end")).collect():
        held = sorted((ts, n, evid) for n, mid, _, evid, _, ts in data
                      if mid == w.mid and evid is not None and w.end - 300_000 <= ts < w.end)
        want += [(f"{w.mid}-{w.end // 60_000}", i, ts, evid) for i, (ts, _, evid) in enumerate(held, 1)]
    assert len(want) > 200 and got == sorted(want)


def test_any_page_opens_its_part_only(spark, tmp_path):
    from tidemart.operators import pages
    rows_of = spark.range(1000).select(*[F.lpad(((F.col("id") * 7919) % 1000).cast("string"), 4, "0").alias(c)
                                         for c in ("dt", "order_id", "order_detail_id")], "id")
    path = str(tmp_path / "pages")
    pages.write_pages(rows_of, path, parts=8)
    for page, size in ((1, 20), (37, 10), (50, 20), (3, 333), (4, 333), (99, 20), (1, 5000)):
        got = pages.read_page(spark, path, page, size)
        want = [f"{n:04d}" for n in range(1000)][(page - 1) * size:page * size]
        assert [r["dt"] for r in got.collect()] == want
        if want and size <= 20:
            assert len({f.split("part=")[1].split("/")[0] for f in got.inputFiles()}) <= 2
    pages.write_pages(rows_of.limit(0), path)
    assert pages.read_page(spark, path, 1, 20).count() == 0
