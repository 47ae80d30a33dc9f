"""The streaming jobs.

Each takes raw streams (``value``, ``timestamp``), a target folder and a
checkpoint folder, and starts one query. All work on a micro-batch uses the
same operators as the batch jobs. Progress lives in the checkpoint; every
write replaces the output of its own batch id, so a repeated batch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemart.functions.columns import day_of, hour_of, previous_day
from tidemart.functions.parse import good, parse_changes, parse_feed, quarantined, with_log_time
from tidemart.operators import alerts, cells, devices, keywords, orders, routing, sales
from tidemart.schemas import (
    ALERT_MIN_USERS, ALERT_WINDOW, CADENCE, DAU_TABLE, JOIN_BOUND_SECONDS, ORDER_TABLE,
    SALE_DETAIL, USER, USER_CADENCE)
from tidemart.session import brief_shuffles
from tidemart.sinks import tables

ONCE = {"availableNow": True}

_CHANGE_TIME = T.StructField("change_ts", T.TimestampType())
_HASH = T.StructField(tables.ROW_HASH, T.LongType())
ORDER_VERSIONS = T.StructType([*ORDER_TABLE.fields, _CHANGE_TIME, _HASH])
USER_VERSIONS = T.StructType([*USER.fields, _CHANGE_TIME, _HASH])
PANES = T.StructType([
    T.StructField("pane", T.TimestampType()), T.StructField("mid", T.StringType()),
    T.StructField("evid", T.StringType()), T.StructField("uid", T.StringType()),
    T.StructField("itemid", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("pane_day", T.StringType())])
#: Buckets of the table of first-seen devices; of three digits at most.
SEEN_BUCKETS = 128
FIRST_SEEN = T.StructType([
    T.StructField("mid", T.StringType()), T.StructField("first_et", T.TimestampType()),
    T.StructField("earlier", T.LongType()), T.StructField("bucket", T.StringType())])
_MOVES = T.StructType([
    T.StructField("log_date", T.StringType()), T.StructField("log_hour", T.StringType()),
    T.StructField("n", T.LongType())])
_WINDOW = [
    T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
    T.StructField("mid", T.StringType())]
JUDGED = T.StructType([
    *_WINDOW, T.StructField("n_users", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("n_events", T.LongType()), T.StructField("clicked", T.BooleanType()),
    T.StructField("index_day", T.StringType())])
LISTED = T.StructType([
    *_WINDOW, T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("index_day", T.StringType())])
_RECEIVED = [T.StructField("rt", T.TimestampType()), T.StructField("rt_day", T.StringType())]
SALE_ORDERS = T.StructType([
    *(T.StructField(n, T.StringType()) for n in "id order_status create_time user_id create_date".split()),
    *_RECEIVED])
SALE_LINES = T.StructType([
    *(T.StructField(n, T.StringType()) for n in "order_id id sku_id order_price sku_name".split()),
    *_RECEIVED])
SALE_VERSIONS = T.StructType([
    *SALE_DETAIL.fields, T.StructField("index_day", T.StringType()),
    T.StructField("joined_rt", T.TimestampType()), _HASH])


def _start(stream: DataFrame, name: str, checkpoint: str, trigger: dict | None, cadence: str,
           write: Callable[[DataFrame, str, int], None], *owned: str) -> StreamingQuery:
    """Run ``write(batch, run, batch_id)`` on every micro-batch; the job's own tables begin
    with it, so that they can be read before it has written to them."""
    owner: list[str] = []
    for path in owned:
        tables.make_folder(stream.sparkSession, path)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not owner:
            owner.append(tables.run_id(batch.sparkSession, checkpoint))
        write(batch, owner[0], batch_id)

    with brief_shuffles(stream.sparkSession):
        return (stream.writeStream.queryName(name).outputMode("append").foreachBatch(on_batch)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": cadence})).start())


@contextmanager
def _kept(rows: DataFrame, wanted: bool = True) -> Iterator[DataFrame]:
    """Hold rows that are used several times within a micro-batch."""
    if wanted:
        rows = rows.persist()
    try:
        yield rows
    finally:
        if wanted:
            rows.unpersist()


def _set_aside(parsed: DataFrame, path: str | None, run: str, batch_id: int) -> None:
    if path:
        tables.write_days(quarantined(parsed).withColumn("day", day_of(F.col("timestamp"))),
                          path, "day", run, batch_id)


def start_quarantine(raw: DataFrame, feed: str, checkpoint: str, quarantine: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """The unreadable records of one feed, for jobs whose state cannot keep them."""
    bad = quarantined(parse_feed(raw, feed)).withColumn("day", day_of(F.col("timestamp")))

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        tables.write_days(batch, quarantine, "day", run, batch_id)

    return _start(bad, f"quarantine_{feed}", checkpoint, trigger, CADENCE, write)


def start_log_router(raw: DataFrame, topics: str, archive: str, checkpoint: str,
                     quarantine: str | None = None, fmt: str = "parquet",
                     trigger: dict | None = None, **options: str) -> StreamingQuery:
    """Stamp raw device logs, archive them by day and send them to their feed."""
    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(routing.route_logs(batch)) as routed:
            tables.archive(routed, archive, run, batch_id)
            fine = routed.where(F.col("error").isNull())
            tables.write_topics(fine, fmt, topics, run, batch_id, **options)
            _set_aside(routed, quarantine, run, batch_id)

    return _start(raw, "log_router", checkpoint, trigger, CADENCE, write)


def start_change_router(changes: DataFrame, topics: str, checkpoint: str,
                        quarantine: str | None = None, fmt: str = "parquet",
                        trigger: dict | None = None, **options: str) -> StreamingQuery:
    """Send the after-images of wanted row changes to their feed.

    ``changes`` are raw change events (``value``, ``timestamp``), of which the unreadable ones
    are set aside, or rows that are typed already.
    """
    raw = "value" in changes.columns

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        if not (raw and quarantine):
            wanted = good(parse_changes(batch)) if raw else batch
            tables.write_topics(routing.route_changes(wanted), fmt, topics, run, batch_id, **options)
            return
        with _kept(routing.route_or_set_aside(parse_changes(batch))) as routed:
            tables.write_topics(routed.where(F.col("error").isNull()), fmt, topics, run, batch_id, **options)
            _set_aside(routed, quarantine, run, batch_id)

    return _start(changes, "change_router", checkpoint, trigger, CADENCE, write)


def start_dau(raw: DataFrame, table: str, checkpoint: str, quarantine: str | None = None,
              trigger: dict | None = None) -> StreamingQuery:
    """First record per device and day, each device and day once over all batches.

    The table itself is the set of seen devices. A later batch never replaces
    a row, even if it holds an earlier record. When a batch is repeated, its
    own former rows and those of later batches do not count as seen.
    """
    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "start"), bool(quarantine)) as parsed:
            with _kept(devices.first_of_day(with_log_time(good(parsed)))) as firsts:
                seen = tables.read_days(
                    batch.sparkSession, table, DAU_TABLE, "log_date",
                    tables.days_of(firsts, F.col("log_date"))).where(
                    (F.col("run") != run) | (F.col("batch") < batch_id))
                known = devices.seen_of(firsts, seen)
                fresh = devices.drop_seen(firsts, known).select(*DAU_TABLE.fieldNames())
                tables.write_days(fresh, table, "log_date", run, batch_id)
            _set_aside(parsed, quarantine, run, batch_id)

    return _start(raw, "dau", checkpoint, trigger, CADENCE, write, table)


def start_dau_state(raw: DataFrame, table: str, checkpoint: str, quarantine: str | None = None,
                    trigger: dict | None = None) -> StreamingQuery:
    """Active devices by their earliest record, without reading what was seen before.

    Each batch writes the earliest time of its own devices and days;
    :func:`active_devices` takes the earliest over the batches. A batch costs
    what it holds, and a record may come any time late: there is no watermark
    to fall behind.
    """
    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "start"), bool(quarantine)) as parsed:
            firsts = (with_log_time(good(parsed)).where(F.col("mid").isNotNull())
                      .groupBy("mid", "log_date").agg(F.min("et").alias("first_et")))
            tables.write_days(firsts, table, "log_date", run, batch_id)
            _set_aside(parsed, quarantine, run, batch_id)

    return _start(raw, "dau_state", checkpoint, trigger, CADENCE, write, table)


def active_devices(spark: SparkSession, table: str, days: list[str] | None = None) -> DataFrame:
    """(mid, log_date, first_et) from the table of :func:`start_dau_state`."""
    layout = T.StructType([
        T.StructField("mid", T.StringType()), T.StructField("first_et", T.TimestampType()),
        T.StructField("log_date", T.StringType())])
    rows = tables.read_days(spark, table, layout, "log_date", days)
    return rows.groupBy("mid", "log_date").agg(F.min("first_et").alias("first_et"))


def start_first_seen(raw: DataFrame, table: str, checkpoint: str, quarantine: str | None = None,
                     period: str = "day", trigger: dict | None = None) -> StreamingQuery:
    """When each device was first seen ever; :func:`new_devices_of` and :func:`first_seen` read it.

    A batch compares the earliest times of its devices with those known, of the buckets its devices
    fall into, and writes what is new or earlier (``<table>/first``). Days are counted by moves
    (``<table>/moves``): a device adds one to its day, and a record that comes late moves it from one
    day to another, so both days are right at once. :func:`fold_first_seen` bounds what a batch reads to one
    row per device of these buckets.
    """
    first_table, move_table = f"{table}/first", f"{table}/moves"

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "start"), bool(quarantine)) as parsed:
            fresh = (with_log_time(good(parsed)).where(F.col("mid").isNotNull())
                     .groupBy("mid").agg(F.min("et").alias("first_et")))
            bucket = F.lpad(F.pmod(F.xxhash64("mid"), F.lit(SEEN_BUCKETS)).cast("string"), 3, "0")
            with _kept(fresh.withColumn("bucket", bucket)) as fresh:
                buckets = [r[0] for r in fresh.select("bucket").distinct().collect()]
                known = tables.read_days(batch.sparkSession, first_table, FIRST_SEEN, "bucket", buckets, "bucket")
                known = (known.where((F.col("run") != run) | (F.col("batch") < batch_id))
                         .join(fresh.select("mid"), "mid", "left_semi")
                         .groupBy("mid").agg(F.min("first_et").alias("was")))
                moved = fresh.join(known, "mid", "left").where(
                    F.col("was").isNull() | (F.col("first_et") < F.col("was")))
                with _kept(moved) as moved:
                    tables.write_days(moved.withColumn("earlier", -F.unix_micros("first_et")).select(
                        *FIRST_SEEN.fieldNames()), first_table, "bucket", run, batch_id, "bucket")
                    steps = moved.select(F.inline(F.array(
                        F.struct(F.col("first_et").alias("at"), F.lit(1).alias("step")),
                        F.struct(F.col("was").alias("at"), F.lit(-1).alias("step"))))).where(F.col("at").isNotNull())
                    counted = steps.groupBy(day_of(F.col("at")).alias("log_date"), hour_of(F.col("at")).alias("log_hour"))
                    tables.write_days(counted.agg(F.sum("step").cast("bigint").alias("n")), move_table, "log_date",
                                      run, batch_id, period)
            _set_aside(parsed, quarantine, run, batch_id)

    return _start(raw, "first_seen", checkpoint, trigger, CADENCE, write, first_table, move_table)


def first_seen(spark: SparkSession, table: str) -> DataFrame:
    """(mid, first_et) of all devices."""
    rows = tables.read_days(spark, f"{table}/first", FIRST_SEEN, "bucket", period="bucket")
    return rows.groupBy("mid").agg(F.min("first_et").alias("first_et"))


def new_devices_of(spark: SparkSession, table: str, days: list[str] | None = None,
                   period: str = "day") -> DataFrame:
    """(log_date, log_hour, ct): devices first seen then, from the moves of these days alone."""
    moves = tables.read_days(spark, f"{table}/moves", _MOVES, "log_date", days, period)
    return moves.groupBy("log_date", "log_hour").agg(F.sum("n").alias("ct")).where(F.col("ct") != 0)


def fold_first_seen(spark: SparkSession, table: str) -> None:
    tables.fold_days(spark, f"{table}/first", FIRST_SEEN, "bucket", None, ["mid", "bucket"], ["earlier"], "bucket")


def start_gmv(raw: DataFrame, table: str, checkpoint: str, quarantine: str | None = None,
              period: str = "day", trigger: dict | None = None) -> StreamingQuery:
    """Cleaned order rows by create date; :func:`current_orders` reads them."""
    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "order"), bool(quarantine)) as parsed:
            rows = orders.clean_orders(good(parsed)).withColumnRenamed("timestamp", "change_ts")
            tables.write_days(tables.versioned(rows, ORDER_VERSIONS), table, "create_date",
                              run, batch_id, period)
            _set_aside(parsed, quarantine, run, batch_id)

    return _start(raw, "gmv", checkpoint, trigger, CADENCE, write, table)


def current_orders(spark: SparkSession, table: str, days: list[str] | None = None,
                   period: str = "day") -> DataFrame:
    """Last version of each order of the given create dates."""
    return tables.latest_days(spark, table, ORDER_VERSIONS, "create_date", ["id", "create_date"], ["change_ts"],
                              days, period).drop("change_ts")


def start_users(raw: DataFrame, table: str, checkpoint: str, quarantine: str | None = None,
                trigger: dict | None = None) -> StreamingQuery:
    """Versions of user rows; :func:`current_users` reads the latest of each."""
    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "user"), bool(quarantine)) as parsed:
            rows = good(parsed).withColumnRenamed("timestamp", "change_ts")
            tables.write_batch(tables.versioned(rows, USER_VERSIONS), table, None, run, batch_id)
            _set_aside(parsed, quarantine, run, batch_id)

    return _start(raw, "users", checkpoint, trigger, USER_CADENCE, write, table)


def user_versions(spark: SparkSession, table: str) -> DataFrame:
    return tables.read_folded(spark, table, USER_VERSIONS)


def fold_users(spark: SparkSession, table: str) -> None:
    """Replace the history of versions by a snapshot of the latest ones."""
    tables.fold(spark, table, USER_VERSIONS, ["id"], "change_ts")


def latest_versions(versions: DataFrame) -> DataFrame:
    return tables.latest(versions, ["id"], "change_ts").drop("change_ts")


def current_users(spark: SparkSession, table: str) -> DataFrame:
    return latest_versions(user_versions(spark, table))


def start_alerts(raw: DataFrame, table: str, checkpoint: str, length: str = ALERT_WINDOW,
                 slide: str = "1 minute", min_users: int = ALERT_MIN_USERS,
                 quarantine: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Alerts of sliding windows; :func:`current_alerts` reads them.

    A batch adds its counted panes to ``<table>/panes`` and judges the windows
    they fall into anew, from all panes of the devices they name. So an alert
    is out with the batch that completes it, a record that comes late, however
    late, changes the windows it belongs to, and a late click takes an alert
    back. Of the panes, those days are read that the windows of the batch touch,
    and of these the stretches of time of each device next to its own records.
    """
    pane_table, judged_table, listed_table = (f"{table}/{x}" for x in ("panes", "windows", "members"))
    reach = alerts.seconds(length)

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        with _kept(parse_feed(batch, "event"), bool(quarantine)) as parsed:
            events = with_log_time(good(parsed))
            with _kept(alerts.panes(events, length, slide).withColumn(
                    "pane_day", day_of(F.col("pane")))) as fresh:
                tables.write_days(fresh, pane_table, "pane_day", run, batch_id)
                span = F.expr(f"INTERVAL {reach} SECONDS")
                days = tables.days_of(fresh, F.col("pane") - span, F.col("pane") + span)
                if days:
                    judge(batch.sparkSession, fresh, days, run, batch_id)
            _set_aside(parsed, quarantine, run, batch_id)

    def judge(spark: SparkSession, fresh: DataFrame, days: list[str], run: str, batch_id: int) -> None:
        touched = alerts.spread(fresh.select("pane", "mid"), length, slide).distinct()
        stretch = F.floor(F.unix_seconds("pane") / F.lit(reach))
        near = fresh.select("mid", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
        known = (tables.read_days(spark, pane_table, PANES, "pane_day", days)
                 .where((F.col("run") != run) | (F.col("batch") <= batch_id))
                 .withColumn("stretch", stretch)
                 .join(near.distinct(), ["mid", "stretch"], "left_semi").drop("stretch"))
        counted = (alerts.spread(known.drop(*tables.BATCH_COLUMNS, "pane_day"), length, slide)
                   .join(touched, alerts.WINDOW_KEY, "left_semi"))
        with _kept(alerts.judge(counted, min_users)) as judged:
            if not judged.count():  # also tells Spark how few the alerts are
                return
            index_day = day_of(F.col("window_end"))
            tables.write_days(judged.withColumn("index_day", index_day), judged_table, "index_day",
                              run, batch_id)
            listed = alerts.members(counted, judged.where(~F.col("clicked")))
            tables.write_days(listed.withColumn("index_day", index_day), listed_table, "index_day",
                              run, batch_id)

    return _start(raw, "alerts", checkpoint, trigger, CADENCE, write,
                  pane_table, judged_table, listed_table)


def _current_windows(spark: SparkSession, table: str, days: list[str] | None) -> DataFrame:
    return alerts.latest_windows(
        tables.read_days(spark, f"{table}/windows", JUDGED, "index_day", days))


def current_alerts(spark: SparkSession, table: str, days: list[str] | None = None) -> DataFrame:
    """Headers of the alerts that stand."""
    return alerts.alert_documents(_current_windows(spark, table, days))


def current_alert_members(spark: SparkSession, table: str, days: list[str] | None = None
                          ) -> DataFrame:
    """Member rows of the alerts that stand, as the batch that judged them last listed them."""
    listed = tables.read_days(spark, f"{table}/members", LISTED, "index_day", days)
    written = _current_windows(spark, table, days).select(*alerts.WINDOW_KEY, *tables.BATCH_COLUMNS)
    rows = listed.join(written, [*alerts.WINDOW_KEY, *tables.BATCH_COLUMNS], "left_semi")
    return alerts.named_members(rows)


def _feed_tables(table: str) -> tuple[str, str]:
    return f"{table}_feeds/orders", f"{table}_feeds/lines"


def names_of(table: str) -> str:
    """The keyword index of a sales table."""
    return f"{table}_names"


def cells_of(table: str) -> str:
    """The facet cells of a sales table."""
    return f"{table}_cells"


def _late_tables(table: str) -> tuple[str, str]:
    return f"{table}_feeds/late_orders", f"{table}_feeds/late_lines"


def _received(batch: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """All records of one of the joined feeds, parsed, and the usable ones with their day of receipt."""
    parsed = parse_feed(batch.where(F.col("feed") == feed), feed)
    rows = good(parsed).withColumnRenamed("timestamp", "rt")
    return parsed, rows.where(F.col("rt").isNotNull()).withColumn("rt_day", day_of(F.col("rt")))


def _with_earlier(rows: DataFrame, near: DataFrame | None) -> DataFrame:
    """The rows of a batch and those of earlier ones that may be their partners' partners."""
    fresh = rows.withColumn("fresh", F.lit(True))
    if near is None:
        return fresh
    return fresh.unionByName(near.select(*rows.columns).withColumn("fresh", F.lit(False)))


class _SalesJoin:
    """The join of fresh orders and lines with what was received around them."""

    def __init__(self, users: str, table: str, as_of: Column | str | None, seconds: int, salts: int, period: str,
                 served: bool = False):
        self.users, self.table, self.as_of = users, table, as_of
        self.seconds, self.salts, self.period, self.served = int(seconds), salts, period, served

    def around(self, fresh: DataFrame, path: str, layout: T.StructType, seen: Column,
               held: ExitStack) -> DataFrame | None:
        """The rows of the other side within the bound of some fresh row's time, at least: of the days
        that the bound touches, the stretches of time next to a fresh row."""
        span = F.expr(f"INTERVAL {self.seconds} SECONDS")
        days = tables.days_of(fresh, F.col("rt") - span, F.col("rt") + span)
        if not days:
            return None
        stretch = F.floor(F.unix_seconds("rt") / F.lit(max(self.seconds, 1)))
        near = held.enter_context(_kept(
            fresh.select(F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()))
        near.count()  # tells Spark how few the stretches are, so that the rows around them are not shuffled for them
        rows = tables.read_days(fresh.sparkSession, path, layout, "rt_day", days).where(seen)
        return rows.withColumn("stretch", stretch).join(near, "stretch", "left_semi").drop("stretch")

    def write(self, heads: DataFrame, lines: DataFrame, run: str, batch_id: int,
              sizes: Sequence[int] | None = None) -> None:
        """Keep the rows in the feed tables, and the pairs they complete in the sales table.

        The rows are made once, for the feed tables, and read back from there for the join. ``sizes`` are
        their numbers, or a little more; without them the rows are counted.
        """
        spark, feeds = heads.sparkSession, _feed_tables(self.table)
        for rows, path, n in zip((heads, lines), feeds, sizes or (heads.count(), lines.count()), strict=True):
            tables.write_days(rows, path, "rt_day", run, batch_id, n_rows=n)
        heads, lines = (tables.read_batch(spark, path, layout, run, batch_id)
                        for path, layout in zip(feeds, (SALE_ORDERS, SALE_LINES), strict=True))
        n_heads, n_lines = heads.count(), lines.count()
        if not n_heads and not n_lines:
            return
        before = (F.col("run") != run) | (F.col("batch") < batch_id)
        with ExitStack() as held:
            near_heads = self.around(lines, feeds[0], SALE_ORDERS, before, held) if n_lines else None
            near_lines = self.around(heads, feeds[1], SALE_LINES, before, held) if n_heads else None
            # one join over the rows of the batch and those around them, so that none is shuffled twice
            heads, lines = (_with_earlier(*sides) for sides in ((heads, near_heads), (lines, near_lines)))
            versions = user_versions(spark, self.users)
            heads = sales.with_user(heads, latest_versions(sales.users_of(heads, versions)))
            self._keep(sales.interval_join(heads, lines, self.seconds, self.salts, sales.USER_VALUES, "fresh"),
                       run, batch_id)

    def _keep(self, pairs: DataFrame, run: str, batch_id: int) -> None:
        """Write the pairs where they are joined; what is served of them is read back from these files
        before they are committed, so that a repeated batch finds none of its own."""
        rows = sales.finished(pairs, F.col("joined_rt") if self.as_of is None else self.as_of)
        rows = rows.withColumn("index_day", day_of(F.col("joined_rt")))
        tables.place_days(tables.versioned(rows, SALE_VERSIONS), self.table, "dt", run, batch_id, self.period,
                          as_made=True)
        if self.served:
            self._serve(tables.read_batch(rows.sparkSession, self.table, SALE_VERSIONS, run, batch_id), run, batch_id)
        tables.commit_days(rows.sparkSession, self.table, run, batch_id)

    def _serve(self, versions: DataFrame, run: str, batch_id: int) -> None:
        """Keyword index and facet cells, brought up to this batch."""
        spark = versions.sparkSession
        keywords.index_names(versions, names_of(self.table), run, batch_id)
        days = sorted(r[0] for r in versions.where("dt IS NOT NULL").select("dt").distinct().collect())
        held = tables.read_days(spark, self.table, SALE_VERSIONS, "dt", days, self.period)
        own = (F.col("run") == run) & (F.col("batch") >= batch_id)
        tables.write_days(cells.changes(versions, held.where(~own), batch_id), cells_of(self.table), "dt",
                          run, batch_id, self.period)


def start_sale_details(order_raw: DataFrame, detail_raw: DataFrame, users: str, table: str,
                       checkpoint: str, as_of: Column | str | None = None,
                       seconds: int = JOIN_BOUND_SECONDS, salts: int = 1, period: str = "day",
                       quarantine: str | None = None, trigger: dict | None = None,
                       served: bool = False) -> StreamingQuery:
    """Order lines joined with orders and users; :func:`current_sales` reads them.

    A batch adds its orders and lines to ``<table>_feeds``, by day of receipt, and joins them with
    what lies within the bound of them, of this and all earlier batches. So each pair is out with
    the batch that completes it, in whatever order and however late its two sides come; a line that
    meets no order leaves silently. Rows received on a day that :func:`close_feeds` closed are kept
    apart (:func:`late_rows`) until :func:`replay_late` joins them. The user table is read anew in
    every batch. Without ``as_of`` the age counts from the day the pair was complete, so a repeated
    batch gives the same row. Unreadable records of both feeds are set aside in ``quarantine``.
    With ``served``, from the first batch on, each batch also keeps the keyword index and the facet
    cells of the table; replays must then say so too, and not run while a batch does. Hot orders are
    split at run time by adaptive execution; ``salts`` spreads every order where that is switched off.
    """
    join = _SalesJoin(users, table, as_of, seconds, salts, period, served)
    if served:
        keywords.begin(order_raw.sparkSession, names_of(table))
        tables.make_folder(order_raw.sparkSession, cells_of(table))

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        closed = _closed_upto(batch.sparkSession, table)
        with _kept(batch, bool(quarantine)) as batch:
            all_heads, heads = _received(batch, "order")
            all_lines, lines = _received(batch, "order_detail")
            heads = orders.clean_orders(heads, hour="colon").select(*SALE_ORDERS.fieldNames())
            lines = lines.select(*SALE_LINES.fieldNames())
            # records are counted, which needs no parse, to tell how many files their rows need
            behind = F.coalesce(day_of(F.col("timestamp")) <= closed, F.lit(False))
            counted = batch.groupBy("feed", behind.alias("behind")).agg(F.count("*").alias("n")).collect()
            sizes = {(r["feed"], r["behind"]): r["n"] for r in counted}
            fresh, late = ([sizes.get((feed, is_late), 0) for feed in ("order", "order_detail")]
                           for is_late in (False, True))
            if closed:
                behind = F.col("rt_day") <= closed
                for rows, path, n in zip((heads, lines), _late_tables(table), late, strict=True):
                    tables.write_days(rows.where(behind), path, "rt_day", run, batch_id, n_rows=n)
                heads, lines = heads.where(~behind), lines.where(~behind)
            join.write(heads, lines, run, batch_id, fresh)
            if quarantine:
                bad = [quarantined(p) for p in (all_heads, all_lines)]
                tables.write_days(bad[0].unionByName(bad[1]).withColumn("day", day_of(F.col("timestamp"))),
                                  quarantine, "day", run, batch_id)

    raw = reduce(DataFrame.unionByName, (
        r.select("value", "timestamp", F.lit(feed).alias("feed"))
        for r, feed in ((order_raw, "order"), (detail_raw, "order_detail"))))
    return _start(raw, "sale_details", checkpoint, trigger, CADENCE, write, table, users,
                  *_feed_tables(table), *_late_tables(table))


def _closed_upto(spark: SparkSession, table: str) -> str:
    return tables.last_mark(spark, f"{table}_feeds/closed")


def close_feeds(spark: SparkSession, table: str, before: str) -> None:
    """End the days of receipt before ``before`` in the feeds of the sales join.

    Their batches are folded into one snapshot a day, so the number of folders stays bounded; rows near
    midnight still find their partners there. What is received for them later is late. Only days that a
    batch was committed for since the last close are folded anew.
    """
    for path, layout in zip(_feed_tables(table), (SALE_ORDERS, SALE_LINES), strict=True):
        days = [d for d in tables.open_periods(spark, path) if d < before]
        tables.fold_days(spark, path, layout, "rt_day", days)
    tables.set_mark(spark, f"{table}_feeds/closed", previous_day(before))


def late_rows(spark: SparkSession, table: str) -> DataFrame:
    """(rt_day, feed, n): rows that came for closed days, replayed or not."""
    counts = [tables.read_days(spark, path, layout, "rt_day").groupBy("rt_day", F.lit(feed).alias("feed"))
              .agg(F.count("*").alias("n")) for path, layout, feed in zip(
                  _late_tables(table), (SALE_ORDERS, SALE_LINES), ("order", "order_detail"), strict=True)]
    return counts[0].unionByName(counts[1])


def replay_late(spark: SparkSession, table: str, users: str, as_of: Column | str | None = None,
                seconds: int = JOIN_BOUND_SECONDS, salts: int = 1, period: str = "day",
                served: bool = False) -> None:
    """Join the late rows with what was received around them, and with each other.

    A replay is a batch of its own (run ``replay``). It takes all late rows, so it may be repeated
    and changes nothing then; a pair that is there already is the same version again.
    """
    number = int(tables.last_mark(spark, f"{table}_feeds/replays") or -1) + 1
    heads, lines = (tables.read_days(spark, path, layout, "rt_day").select(*layout.fieldNames())
                    for path, layout in zip(_late_tables(table), (SALE_ORDERS, SALE_LINES), strict=True))
    with brief_shuffles(spark):
        _SalesJoin(users, table, as_of, seconds, salts, period, served).write(heads, lines, "replay", number)
    tables.set_mark(spark, f"{table}_feeds/replays", f"{number:08d}")


def current_sales(spark: SparkSession, table: str, days: list[str] | None = None,
                  period: str = "day") -> DataFrame:
    """Latest document per order detail id."""
    return tables.latest_days(spark, table, SALE_VERSIONS, "dt", ["order_detail_id", "dt"], ["joined_rt"],
                              days, period).drop("joined_rt")


def current_cells(spark: SparkSession, table: str, days: list[str] | None = None, level: str | None = None,
                  period: str = "day") -> DataFrame:
    """Sales per gender and age class, from the cells alone."""
    return cells.total_of(tables.read_days(spark, cells_of(table), cells.CELLS, "dt", days, period), level)
