"""Named queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions import columns as C
from tidemart.functions.columns import event_time
from tidemart.functions.parse import good, parse_feed, parsed_once, quarantined, with_log_time
from tidemart.operators import (
    alerts, cells, devices, dimension, keywords, orders, pages, routing, sales, search, serving)
from tidemart.plans import mapping as M
from tidemart.plans.mapping import AS_OF, table
from tidemart.schemas import FEEDS, SALE_DETAIL
from tidemart.session import brief_shuffles, new_folder, prepare, shuffle_partitions
from tidemart.sinks import tables
from tidemart.sources import feeds
from tidemart.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = "2024-01-15"
ORDER_DAY = "1998-03-02"
KEYWORD = "RING"
KEYWORDS = ("g", "In", "rin", "RING", "t r", "ed ring", "ringring")
ALERT_LENGTH, ALERT_SLIDE = "2 hours", "30 minutes"


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    QUERIES[run.__name__] = prepared
    return prepared


# --- feeds as the operators expect them ---------------------------------------

def _logs(spark, sf):
    return M.timed_start_logs(table(spark, sf, "events"))


def _active(spark, sf, *days):
    """Activity of all days, or of the days from the first to the last named."""
    events = table(spark, sf, "events")
    events = M.on_days(events, days[0], days[-1]) if days else events
    return devices.with_first_hour(devices.active_days(M.timed_start_logs(events)))


def _new(spark, sf):
    return devices.new_devices(_logs(spark, sf), "et")


def _orders(spark, sf, *days):
    """Orders of all days, or of the days from the first to the last named."""
    rows = table(spark, sf, "orders")
    rows = M.on_order_days(rows, days[0], days[-1]) if days else rows
    return orders.clean_orders(M.typed_orders(rows))


def _purchases(spark, sf, *days):
    events = table(spark, sf, "events")
    events = M.on_days(events, days[0], days[-1]) if days else events
    return orders.clean_orders(M.purchases(events))


def _details(spark, sf):
    return M.typed_details(table(spark, sf, "lineitem"), table(spark, sf, "part"))


def _users(spark, sf):
    return M.user_feed(table(spark, sf, "customer"))


def _sales(spark, sf, *days):
    return sales.enriched_sale_details(_orders(spark, sf, *days), _details(spark, sf),
                                       _users(spark, sf), AS_OF)


def _metric_tables(spark, sf, day):
    days = C.previous_day(day), day
    return {"dau": _active(spark, sf, *days), "new_mids": _new(spark, sf),
            "orders": _purchases(spark, sf, *days)}


# --- devices -------------------------------------------------------------------

@query
def dau_first_of_day(spark, sf):
    return (devices.first_of_day(_logs(spark, sf), "event_id")
            .select("mid", "log_date", "log_hour", "uid", "type", "ts", "event_id"))


@query
def dau_anti_seen(spark, sf):
    """The whole day as a new batch after the mornings were already counted."""
    logs = _logs(spark, sf)
    seen = devices.active_days(logs.where(F.col("log_hour") < "12"))
    return (devices.drop_seen(devices.first_of_day(logs, "event_id"), seen)
            .select("mid", "log_date", "log_hour", "uid", "event_id"))


@query
def dau_total(spark, sf):
    return devices.dau_total(_active(spark, sf, DAY), DAY)


@query
def dau_by_day(spark, sf):
    return devices.dau_by_day(_active(spark, sf))


@query
def dau_by_hour(spark, sf):
    return devices.dau_by_hour(_active(spark, sf))


@query
def dau_hours_compare(spark, sf):
    return serving.metric_hours(spark, "dau", DAY, **_metric_tables(spark, sf, DAY))


@query
def new_devices_by_day(spark, sf):
    return devices.new_devices_by_day(_logs(spark, sf), "et")


def _first_orders(spark, sf):
    """Customers as devices that are active when they order: new ones come over many years."""
    rows = _orders(spark, sf)
    return rows.select(F.col("user_id").alias("mid"), F.col("create_time").cast("timestamp").alias("et"))


@query
def new_buyers_by_day(spark, sf):
    return devices.new_devices_by_day(_first_orders(spark, sf), "et")


@query
def new_mid_hours_compare(spark, sf):
    day = "2024-01-02"
    return serving.metric_hours(spark, "new_mid", day, **_metric_tables(spark, sf, day))


@query
def dau_hours_payload(spark, sf):
    rows = serving.metric_rows("dau", DAY, **_metric_tables(spark, sf, DAY))
    return serving.hours_payload(rows)


# --- order value ---------------------------------------------------------------

@query
def gmv_clean_rows(spark, sf):
    return _orders(spark, sf).select("id", "user_id", "total_amount", "consignee_tel",
                                     "create_date", "create_hour")


@query
def gmv_total_by_day(spark, sf):
    return orders.gmv_by_day(_orders(spark, sf))


@query
def gmv_total_one_day(spark, sf):
    return orders.gmv_total(_orders(spark, sf, ORDER_DAY), ORDER_DAY)


@query
def gmv_by_hour(spark, sf):
    return orders.gmv_by_hour(_orders(spark, sf))


@query
def purchase_gmv_by_hour(spark, sf):
    return orders.gmv_by_hour(_purchases(spark, sf))


@query
def gmv_hours_compare(spark, sf):
    return serving.metric_hours(spark, "order_amount", DAY, **_metric_tables(spark, sf, DAY))


@query
def totals_card(spark, sf):
    return serving.totals_card(*_metric_tables(spark, sf, DAY).values(), day=DAY)


@query
def totals_payload(spark, sf):
    return serving.totals_payload(totals_card(spark, sf))


@query
def order_upsert_last(spark, sf):
    return (orders.last_write(M.order_changes(table(spark, sf, "orders")))
            .select("id", "order_status", "total_amount", "create_time"))


@query
def sales_by_province(spark, sf):
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("province_id"))
    provinces = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("province_id"), F.col("n_name").alias("province_name"))
    return orders.sales_by_province(_orders(spark, sf), people, provinces)


# --- sale details --------------------------------------------------------------

@query
def sale_detail_full_outer(spark, sf):
    return sales.full_outer_lines(_orders(spark, sf), _details(spark, sf))


@query
def sale_detail_inner(spark, sf):
    return sales.join_lines(_orders(spark, sf), _details(spark, sf))


@query
def sale_detail_enriched(spark, sf):
    return _sales(spark, sf)


@query
def sale_detail_interval(spark, sf):
    return sales.interval_join(_orders(spark, sf), _details(spark, sf)).select(
        "order_id", "order_detail_id", "user_id", "sku_name", "sku_price",
        F.unix_millis("joined_rt").alias("joined_ms"))


@query
def user_latest(spark, sf):
    return (dimension.latest_users(M.user_changes(table(spark, sf, "customer")))
            .drop("change_ts"))


@query
def user_age(spark, sf):
    return _users(spark, sf).select(
        "id", "birthday", C.age_in_years(F.col("birthday"), AS_OF).alias("age"))


# --- search --------------------------------------------------------------------

@query
def search_page(spark, sf):
    return search.search(_sales(spark, sf), keyword=KEYWORD, page=2, size=20).detail


@query
def search_page_after(spark, sf):
    """The same rows as page 3, read on from the last row of page 2."""
    hits = search.filter_sales(_sales(spark, sf), keyword=KEYWORD)
    return search.page_after(hits, search.cursor(search.page_of(hits, 2, 20)), 20)


@query
def search_total(spark, sf):
    return search.search(_sales(spark, sf), keyword=KEYWORD).total


@query
def search_by_level(spark, sf):
    hits = search.filter_sales(_sales(spark, sf), keyword=KEYWORD, level="BUILDING")
    return search.hit_total(hits)


@query
def search_by_day(spark, sf):
    return search.filter_sales(_sales(spark, sf, ORDER_DAY), day=ORDER_DAY)


@query
def facet_gender(spark, sf):
    return search.gender_share(_sales(spark, sf))


@query
def facet_age(spark, sf):
    return search.age_share(_sales(spark, sf))


@query
def search_response_total(spark, sf):
    """Total and facet values read back from the JSON response."""
    answer = search.response(search.search(_sales(spark, sf), keyword=KEYWORD, page=1, size=5))
    return answer.select(
        F.get_json_object("value", "$.total").cast("bigint").alias("total"),
        F.get_json_object("value", "$.stat[1].options[0].value").cast("bigint")
        .alias("first_gender"),
        F.get_json_object("value", "$.detail[0].order_detail_id").alias("first_row"),
        F.get_json_object("value", "$.detail[4].order_detail_id").alias("fifth_row"))


@query
def search_response_rows(spark, sf):
    """The whole JSON response, read back: total, both facets and the page, each in its order."""
    answer = search.response(search.search(_sales(spark, sf), keyword=KEYWORD, page=2, size=50))
    option = "array<struct<name:string,value:bigint,share_pct:double>>"
    layout = (f"total bigint, stat array<struct<options:{option}>>, "
              f"detail array<struct<{SALE_DETAIL.simpleString()[len('struct<'):-1]}>>")
    doc = answer.select(parsed_once(F.col("value"), layout).alias("doc"))

    def rows(part: str, entries: Column, name, value) -> Column:
        return F.transform(entries, lambda e, i: F.struct(
            F.lit(part).alias("part"), i.alias("pos"), name(e).alias("name"), value(e).alias("value")))

    def texts(d: Column) -> Column:
        names = [c for c in SALE_DETAIL.fieldNames() if c != "sku_price"]
        return F.concat_ws("|", *[F.coalesce(d[c].cast("string"), F.lit("-")) for c in names])

    options = [rows(part, F.col("doc.stat")[i]["options"],
                    lambda o: F.concat_ws("|", o["name"], o["value"].cast("string")), lambda o: o["share_pct"])
               for i, part in enumerate(("age", "gender"))]
    total = rows("total", F.array(F.col("doc.total")), lambda t: F.lit(None).cast("string"), lambda t: t.cast("double"))
    return doc.select(F.inline(F.concat(total, *options, rows("detail", F.col("doc.detail"), texts, lambda d: d["sku_price"]))))


@query
def search_page_directory(spark, sf):
    """Page 250 of all sales from the listing that is kept in order; one or two of its parts are read."""
    folder = new_folder(spark, "pages")
    pages.write_pages(_sales(spark, sf), folder)
    return pages.read_page(spark, folder, 250, 20)


def _named_sales(spark, sf):
    """Day and product of all sales as a table: the sales are joined once for all batches and keywords."""
    folder = new_folder(spark, "named")
    _sales(spark, sf).select("dt", *keywords.NAME).write.parquet(folder)
    return spark.read.parquet(folder)


def _keyword_index(spark, rows):
    """The index of all sales, grown by two batches that share names, then folded, then by a third."""
    folder = new_folder(spark, "names")
    year = F.substring("dt", 1, 4).cast("int")
    for batch, part in enumerate((year < 1994, (year >= 1994) & (year < 1997), year >= 1997)):
        keywords.index_names(rows.where(part), folder, "all", batch)
        if batch == 1:
            keywords.fold(spark, folder)
    return folder


@query
def search_page_indexed(spark, sf):
    """Page 2 of the hits of a keyword that is looked up in posting lists; the sales are read by name."""
    index = _keyword_index(spark, _named_sales(spark, sf))
    hits = keywords.sales_with(_sales(spark, sf), index, KEYWORD)
    return search.search(hits, page=2, size=20).detail


@query
def search_totals_indexed(spark, sf):
    """Hits of keywords of one, two, three and more characters, across words and of none."""
    rows = _named_sales(spark, sf)
    folder = _keyword_index(spark, rows)
    return reduce(DataFrame.unionByName, (
        search.hit_total(keywords.sales_with(rows, folder, word)).select(
            F.lit(word).alias("keyword"), "total") for word in KEYWORDS))


# --- alerts --------------------------------------------------------------------

def _counted(spark, sf):
    return alerts.windowed(M.event_logs(table(spark, sf, "events")),
                           ALERT_LENGTH, ALERT_SLIDE)


def _found(spark, sf):
    """Alerting windows as a table: few rows, whose size Spark then knows."""
    folder = new_folder(spark, "alert-windows")
    alerts.detect(_counted(spark, sf)).write.parquet(folder)
    return spark.read.parquet(folder)


@query
def coupon_alert(spark, sf):
    return alerts.detect(_counted(spark, sf)).select(
        "mid", F.unix_millis("window_start").alias("start_ms"),
        F.unix_millis("window_end").alias("end_ms"), "n_users")


@query
def alert_docs(spark, sf):
    return alerts.alert_documents(_found(spark, sf))


@query
def alert_members(spark, sf):
    return alerts.alert_members(_counted(spark, sf), _found(spark, sf)).drop("ts", "index_day")


@query
def alert_events(spark, sf):
    """The events of every alert, in order."""
    events = M.event_logs(table(spark, sf, "events")).withColumn("id", F.col("event_id"))
    return alerts.alert_events(events, _found(spark, sf), ALERT_LENGTH)


@query
def coupon_alert_fine(spark, sf):
    """The reference cadence: windows of five minutes that slide by five seconds, over events
    brought a hundred times closer together."""
    events = M.event_logs(table(spark, sf, "events"))
    dense = events.withColumn("et", F.timestamp_millis(F.floor(F.col("ts") / 100).cast("bigint")))
    found = alerts.detect(alerts.windowed(dense, "5 minutes", "5 seconds"))
    return found.select("mid", F.unix_millis("window_end").alias("end_ms"), "n_users", "n_items",
                        "n_events")


@query
def alert_index(spark, sf):
    """Documents per daily index."""
    docs = alerts.alert_documents(_found(spark, sf))
    return (docs.groupBy(C.index_name("coupon_alert", F.col("index_day")).alias("index_name"))
            .agg(F.count_distinct("doc_id").alias("docs")))


# --- raw records and routing ---------------------------------------------------

def _broken_some(rows: DataFrame, when) -> DataFrame:
    """Raw records of which some are cut off in the middle."""
    half = F.expr("substring(value, 1, length(value) div 2)")
    return rows.select(F.when(when, half).otherwise(F.col("value")).alias("value"), "timestamp")


def _raw_start(spark, sf):
    logs = M.start_logs(table(spark, sf, "events"))
    rows = logs.select(F.to_json(F.struct("mid", "uid", "type", "ts")).alias("value"),
                       event_time(F.col("ts")).alias("timestamp"), "mid")
    return _broken_some(rows, F.col("mid") == "13")


@query
def parse_start_log(spark, sf):
    rows = with_log_time(good(parse_feed(_raw_start(spark, sf), "start")))
    return rows.select("mid", "uid", "type", "ts", "log_date", "log_hour")


@query
def parse_quarantine(spark, sf):
    return (quarantined(parse_feed(_raw_start(spark, sf), "start"))
            .groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "error")
            .agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")))


@query
def parse_orders(spark, sf):
    feed = M.order_feed(table(spark, sf, "orders"))
    raw = M.raw(feed, *[c for c in feed.columns if c != "rt"], at=F.col("rt"))
    return orders.clean_orders(good(parse_feed(raw, "order")), "colon").select(
        "id", "user_id", "order_status", "total_amount", "consignee_tel",
        "create_date", "create_hour")


@query
def log_routing_counts(spark, sf):
    logs = M.start_logs(table(spark, sf, "events"))
    raw = M.raw(logs, "mid", "uid", "type", at=event_time(F.col("ts")))
    return (routing.route_logs(raw).groupBy("topic")
            .agg(F.count("*").alias("n"),
                 F.sum(F.get_json_object("value", "$.ts").cast("bigint")).alias("ts_sum")))


@query
def cdc_routing(spark, sf):
    changes = M.change_feed(*[table(spark, sf, n)
                              for n in ("orders", "lineitem", "part", "customer")])
    return routing.route_changes(changes).select("topic", "value")


# --- streams: run once over the tables, then read the sink ----------------------

def _finish(spark, start, *args, **options):
    """Run a job until it has read all there is; one state partition per core."""
    with shuffle_partitions(spark, spark.sparkContext.defaultParallelism):
        start(*args, **options, trigger=jobs.ONCE).awaitTermination()


def _stream_start(spark, sf):
    logs = M.start_logs(M.stream(spark, sf, "events"))
    return M.raw(logs, "mid", "uid", "type", "ts", at=event_time(F.col("ts")))


@query
def stream_dau(spark, sf):
    folder = new_folder(spark, "dau")
    _finish(spark, jobs.start_dau, _stream_start(spark, sf), f"{folder}/table",
            f"{folder}/progress")
    rows = tables.read_days(spark, f"{folder}/table", jobs.DAU_TABLE, "log_date")
    return rows.select("mid", "log_date", "log_hour", "ts")


@query
def stream_dau_state(spark, sf):
    folder = new_folder(spark, "dau-state")
    _finish(spark, jobs.start_dau_state, _stream_start(spark, sf), f"{folder}/table",
            f"{folder}/progress")
    days = devices.with_first_hour(jobs.active_devices(spark, f"{folder}/table"))
    return days.select("mid", "log_date", "log_hour", F.unix_millis("first_et").alias("ts"))


def _stream_orders(spark, sf):
    feed = M.order_feed(M.stream(spark, sf, "orders"))
    return M.raw(feed, *[c for c in feed.columns if c != "rt"], at=F.col("rt"))


@query
def stream_gmv(spark, sf):
    folder = new_folder(spark, "gmv")
    _finish(spark, jobs.start_gmv, _stream_orders(spark, sf), f"{folder}/table",
            f"{folder}/progress", period="month")
    return orders.gmv_by_hour(jobs.current_orders(spark, f"{folder}/table", period="month"))


def _run_users(spark, sf, folder):
    changes = M.user_changes(M.stream(spark, sf, "customer"))
    raw = M.raw(changes, *[c for c in changes.columns if c != "change_ts"],
                at=F.col("change_ts"))
    _finish(spark, jobs.start_users, raw, f"{folder}/users", f"{folder}/users-progress")


@query
def stream_users(spark, sf):
    folder = new_folder(spark, "users")
    _run_users(spark, sf, folder)
    return jobs.current_users(spark, f"{folder}/users")


@query
def stream_sale_details(spark, sf):
    folder = new_folder(spark, "sales")
    _run_users(spark, sf, folder)
    details = M.detail_feed(M.stream(spark, sf, "lineitem"), table(spark, sf, "part"))
    detail_raw = M.raw(details, *[c for c in details.columns if c != "rt"], at=F.col("rt"))
    _finish(spark, jobs.start_sale_details, _stream_orders(spark, sf), detail_raw,
            f"{folder}/users", f"{folder}/table", f"{folder}/progress", as_of=AS_OF,
            period="month")
    return (jobs.current_sales(spark, f"{folder}/table", period="month")
            .select(*SALE_DETAIL.fieldNames(), "index_day"))


def _hours_as_stream(raw, folder, hours, part):
    """The records received in one part of the day, of so many hours, as further files of a folder, and the
    folder as a stream: a run of a job takes all that is new as one batch."""
    rows = raw.where(F.floor(F.hour("timestamp") / hours) == part)
    with brief_shuffles(raw.sparkSession):
        rows.write.mode("append").parquet(folder)
    return feeds.read_feed_stream(raw.sparkSession, None, "parquet", folder)


def _sale_feeds(spark, sf):
    """Raw orders and order lines."""
    heads = M.order_feed(table(spark, sf, "orders"))
    lines = M.detail_feed(table(spark, sf, "lineitem"), table(spark, sf, "part"))
    return [(name, M.raw(rows, *[c for c in rows.columns if c != "rt"], at=F.col("rt")))
            for name, rows in (("orders", heads), ("lines", lines))]


@query
def stream_sales_late(spark, sf):
    """Each quarter of both feeds comes after all that was received later; the sales are those of the whole."""
    folder = new_folder(spark, "sales-late")
    _run_users(spark, sf, folder)
    raws = _sale_feeds(spark, sf)
    for quarter in (3, 2, 1, 0):
        streams = [_hours_as_stream(raw, f"{folder}/in-{name}", 6, quarter) for name, raw in raws]
        _finish(spark, jobs.start_sale_details, *streams, f"{folder}/users", f"{folder}/table",
                f"{folder}/progress", as_of=AS_OF, period="month")
    return (jobs.current_sales(spark, f"{folder}/table", period="month")
            .select(*SALE_DETAIL.fieldNames(), "index_day"))


@query
def stream_sales_replayed(spark, sf):
    """The second half of the day of receipt comes first, then the day is closed; the first half is late
    and joined by a replay. The sales are those of the whole, also from folded tables."""
    folder = new_folder(spark, "sales-replayed")
    _run_users(spark, sf, folder)
    raws = _sale_feeds(spark, sf)
    for half in (1, 0):
        streams = [_hours_as_stream(raw, f"{folder}/in-{name}", 12, half) for name, raw in raws]
        _finish(spark, jobs.start_sale_details, *streams, f"{folder}/users", f"{folder}/table",
                f"{folder}/progress", as_of=AS_OF, period="month")
        if half:
            day = raws[0][1].agg(F.max(F.date_format("timestamp", "yyyy-MM-dd"))).first()[0]
            jobs.close_feeds(spark, f"{folder}/table", C.next_day(day))
    jobs.replay_late(spark, f"{folder}/table", f"{folder}/users", as_of=AS_OF, period="month")
    tables.fold_days(spark, f"{folder}/table", jobs.SALE_VERSIONS, "dt", None, ["order_detail_id", "dt"],
                     ["joined_rt"], "month")
    return (jobs.current_sales(spark, f"{folder}/table", period="month")
            .select(*SALE_DETAIL.fieldNames(), "index_day"))


@query
def stream_gmv_folded(spark, sf):
    """Order value from a table whose months were folded between two runs of the stream."""
    folder = new_folder(spark, "gmv-folded")
    feed = M.order_feed(table(spark, sf, "orders"))
    raw = M.raw(feed, *[c for c in feed.columns if c != "rt"], at=F.col("rt"))
    for half in (0, 1):
        raw.where(F.floor(F.hour("timestamp") / 12) == half).write.mode("append").parquet(f"{folder}/in")
        stream = feeds.read_feed_stream(spark, None, "parquet", f"{folder}/in")
        _finish(spark, jobs.start_gmv, stream, f"{folder}/table", f"{folder}/progress", period="month")
        if not half:
            tables.fold_days(spark, f"{folder}/table", jobs.ORDER_VERSIONS, "create_date", None,
                             ["id", "create_date"], ["change_ts"], "month")
    return orders.gmv_by_hour(jobs.current_orders(spark, f"{folder}/table", period="month"))


@query
def stream_new_buyers(spark, sf):
    """First-seen devices fed with later years first: days are corrected as earlier records come."""
    folder = new_folder(spark, "first-seen")
    first = _first_orders(spark, sf)
    raw = M.raw(first.withColumn("ts", F.unix_millis("et")), "mid", "ts", at=F.col("et"))
    for late in (True, False):
        part = raw.where((F.year("timestamp") > 1994) == late)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = feeds.read_feed_stream(spark, None, "parquet", f"{folder}/in", maxFilesPerTrigger="1")
    _finish(spark, jobs.start_first_seen, stream, f"{folder}/table", f"{folder}/progress",
            period="month")
    return (jobs.new_devices_of(spark, f"{folder}/table", period="month").groupBy("log_date")
            .agg(F.sum("ct").alias("new_devices")))


def _start_files(spark, sf, folder, days):
    """Start logs of some days of the month as further files of a folder, and the folder as a stream. A file
    holds whole days, so that a day comes in one batch also where a job sees some of the files first."""
    logs = M.start_logs(table(spark, sf, "events"))
    raw = M.raw(logs, "mid", "uid", "type", "ts", at=event_time(F.col("ts")))
    rows = raw.where(F.dayofmonth("timestamp").between(*days))
    rows.repartitionByRange(F.to_date("timestamp")).write.mode("append").parquet(f"{folder}/in")
    return feeds.read_feed_stream(spark, None, "parquet", f"{folder}/in")


def _dau_table(spark, folder):
    rows = tables.read_days(spark, f"{folder}/table", jobs.DAU_TABLE, "log_date")
    return rows.select("mid", "log_date", "log_hour", "ts")


@query
def stream_dau_restarts(spark, sf):
    """Three runs of one job over a growing folder: each goes on where the one before stopped."""
    folder = new_folder(spark, "dau-restarts")
    for days in ((1, 10), (11, 20), (21, 31)):
        stream = _start_files(spark, sf, folder, days)
        _finish(spark, jobs.start_dau, stream, f"{folder}/table", f"{folder}/progress")
    return _dau_table(spark, folder)


@query
def stream_dau_cadence(spark, sf):
    """A job that runs on: files come while it is up, and it is stopped once it has read them all."""
    folder = new_folder(spark, "dau-cadence")
    running = jobs.start_dau(_start_files(spark, sf, folder, (1, 15)), f"{folder}/table", f"{folder}/progress",
                             trigger={"processingTime": "500 milliseconds"})
    try:
        running.processAllAvailable()
        _start_files(spark, sf, folder, (16, 31))
        running.processAllAvailable()
    finally:
        running.stop()
    return _dau_table(spark, folder)


@query
def stream_alerts(spark, sf):
    folder = new_folder(spark, "alerts")
    logs = M.event_logs(M.stream(spark, sf, "events"))
    raw = M.raw(logs, "mid", "uid", "evid", "itemid", "ts", at=event_time(F.col("ts")))
    _finish(spark, jobs.start_alerts, raw, f"{folder}/table", f"{folder}/progress",
            ALERT_LENGTH, ALERT_SLIDE)
    return jobs.current_alerts(spark, f"{folder}/table")


def _out_of_order(spark, rows, folder, *columns):
    """The records as a stream of files, later days first, one file a batch."""
    raw = M.raw(rows, *columns, at=event_time(F.col("ts")))
    for half in (F.dayofmonth("timestamp") > 15, F.dayofmonth("timestamp") <= 15):
        (raw.where(half).select("value", "timestamp").coalesce(1).write.mode("append")
         .parquet(f"{folder}/in"))
    return feeds.read_feed_stream(spark, None, "parquet", f"{folder}/in", maxFilesPerTrigger="1")


@query
def stream_alerts_late(spark, sf):
    """Half of the events come after all later ones; the alerts are those of the whole."""
    folder = new_folder(spark, "alerts-late")
    logs = M.event_logs(table(spark, sf, "events"))
    raw = _out_of_order(spark, logs, folder, "mid", "uid", "evid", "itemid", "ts")
    _finish(spark, jobs.start_alerts, raw, f"{folder}/table", f"{folder}/progress",
            ALERT_LENGTH, ALERT_SLIDE)
    return jobs.current_alert_members(spark, f"{folder}/table").drop("ts", "index_day")


@query
def stream_dau_late(spark, sf):
    folder = new_folder(spark, "dau-late")
    logs = M.start_logs(table(spark, sf, "events"))
    raw = _out_of_order(spark, logs, folder, "mid", "uid", "type", "ts")
    _finish(spark, jobs.start_dau_state, raw, f"{folder}/table", f"{folder}/progress")
    days = devices.with_first_hour(jobs.active_devices(spark, f"{folder}/table"))
    return days.select("mid", "log_date", "log_hour", F.unix_millis("first_et").alias("ts"))


@query
def change_quarantine(spark, sf):
    """Cut-off change events that the router sets aside, and what it routes of the rest."""
    folder = new_folder(spark, "change-quarantine")
    typed = M.change_feed(*[M.stream(spark, sf, n)
                            for n in ("orders", "lineitem", "part", "customer")])
    raw = M.raw(typed, "entry_type", "table", "op", "ts", "after", at=F.col("ts"))
    broken = _broken_some(raw, F.contains("value", F.lit("order_info")))
    _finish(spark, jobs.start_change_router, broken, f"{folder}/topics", f"{folder}/progress",
            f"{folder}/quarantine")
    aside = spark.read.parquet(f"{folder}/quarantine").groupBy(F.col("error").alias("kind"))
    routed = spark.read.parquet(f"{folder}/topics").groupBy(F.col("topic").alias("kind"))
    return aside.agg(F.count("*").alias("n")).unionByName(routed.agg(F.count("*").alias("n")))


@query
def stream_log_router(spark, sf):
    """Records per topic with a sum over their hashed texts, and the archive next to them."""
    folder = new_folder(spark, "logs")
    logs = M.start_logs(M.stream(spark, sf, "events"))
    raw = M.raw(logs, "mid", "uid", "type", at=event_time(F.col("ts")))
    _finish(spark, jobs.start_log_router, raw, f"{folder}/topics", f"{folder}/archive",
            f"{folder}/progress")
    texts = [F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5("value"), 1, 8), 16, 10)
                                            .cast("bigint")).alias("texts")]
    routed = spark.read.parquet(f"{folder}/topics").groupBy("topic").agg(*texts)
    kept = (spark.read.parquet(f"{folder}/archive")
            .groupBy(F.concat(F.lit("archive "), F.col("day").cast("string")).alias("topic"))
            .agg(*texts))
    return routed.unionByName(kept)


@query
def stream_change_router(spark, sf):
    """Routed row changes, read back as typed feeds."""
    folder = new_folder(spark, "changes")
    changes = M.change_feed(*[M.stream(spark, sf, n)
                              for n in ("orders", "lineitem", "part", "customer")])
    _finish(spark, jobs.start_change_router, changes, f"{folder}/topics",
            f"{folder}/progress")
    return _routed_changes(spark, folder)


@query
def stream_change_files(spark, sf):
    """The same from raw change events in text files, two thirds of the files in the first batch."""
    folder = new_folder(spark, "change-files")
    typed = M.change_feed(*[table(spark, sf, n) for n in ("orders", "lineitem", "part", "customer")])
    raw = M.raw(typed, "entry_type", "table", "op", "ts", "after", at=F.col("ts"))
    raw.select("value").write.text(f"{folder}/in", compression="gzip")
    n_files = len(spark.read.text(f"{folder}/in").inputFiles())
    changes = feeds.read_changes_stream(spark, f"{folder}/in", max_files=max(1, n_files * 2 // 3))
    _finish(spark, jobs.start_change_router, changes, f"{folder}/topics", f"{folder}/progress")
    return _routed_changes(spark, folder)


def _routed_changes(spark, folder):
    routed = []
    for name, amount in (("order", "total_amount"), ("order_detail", "order_price"), ("user", None)):
        rows = good(parse_feed(feeds.read_topic(spark, f"{folder}/topics", FEEDS[name].topic),
                               name))
        routed.append(rows.select(
            F.lit(FEEDS[name].topic).alias("topic"), "id",
            (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount"),
            (F.lit(None).cast("string") if amount else F.col("user_level")).alias("level")))
    return routed[0].unionByName(routed[1]).unionByName(routed[2])


@query
def stream_facet_cells(spark, sf):
    """Facet cells kept by the sales job. All orders come again after all user changes: their sales
    move from the cells of the users' first values to those of the last."""
    folder = new_folder(spark, "cells")
    changes = M.user_changes(table(spark, sf, "customer"))
    feed = M.order_feed(table(spark, sf, "orders"))
    heads = M.raw(feed, *[c for c in feed.columns if c != "rt"], at=F.col("rt"))
    feed = M.detail_feed(M.stream(spark, sf, "lineitem"), table(spark, sf, "part"))
    lines_in = M.raw(feed, *[c for c in feed.columns if c != "rt"], at=F.col("rt"))
    first = F.col("change_ts") < F.lit("2024-02-01").cast("timestamp")
    for known in (first, ~first):
        rows = changes.where(known)
        M.raw(rows, *[c for c in rows.columns if c != "change_ts"], at=F.col("change_ts")).write.mode(
            "append").parquet(f"{folder}/in-users")
        heads.write.mode("append").parquet(f"{folder}/in-orders")
        users, orders_in = (feeds.read_feed_stream(spark, None, "parquet", f"{folder}/in-{name}")
                            for name in ("users", "orders"))
        _finish(spark, jobs.start_users, users, f"{folder}/users", f"{folder}/users-progress")
        _finish(spark, jobs.start_sale_details, orders_in, lines_in, f"{folder}/users", f"{folder}/table",
                f"{folder}/progress", as_of=AS_OF, period="month", served=True)
    return (tables.read_days(spark, jobs.cells_of(f"{folder}/table"), cells.CELLS, "dt", None, "month")
            .groupBy("user_level", "gender", "age").agg(F.sum("n").alias("n")).where("n <> 0"))
