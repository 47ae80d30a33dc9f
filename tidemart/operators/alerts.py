"""Coupon-fraud alerts over sliding windows.

A device alerts in a window when at least ``min_users`` different users took a
coupon on it and nobody clicked an item. An alert has a header (counts) and
member rows: the users, the items and all event names of the device in the
window, each with its number of events. That shape is the same at every size;
no row grows with the data.

Events are first counted per *pane*, the longest stretch that no window border
cuts, and only then spread over the windows: what is multiplied by
length / slide is the counted panes. Everything after works on *counted
events*: rows (window_start, window_end, mid, evid, uid, itemid, n), where uid
and itemid are only kept for coupons. No step gathers a device: the distinct
users are counted in two steps, first spread over (window, device, user) and
only then over (window, device).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemart.functions.columns import day_of
from tidemart.operators.keyed import last_per_key
from tidemart.schemas import (
    ALERT_DOC, ALERT_MEMBER, ALERT_MIN_USERS, ALERT_WINDOW, CLICK_EVENT, COUPON_EVENT)

WINDOW_KEY = ["window_start", "window_end", "mid"]
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(span: str) -> int:
    """"5 minutes" as seconds."""
    number, unit = span.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def panes(events: DataFrame, length: str = ALERT_WINDOW, slide: str = "1 minute") -> DataFrame:
    """Events counted per pane: (pane, mid, evid, uid, itemid, n).

    ``events`` has mid, uid, evid, itemid and the event time ``et``.
    """
    pane = gcd(seconds(length), seconds(slide))
    coupon = F.col("evid") == COUPON_EVENT
    at = F.timestamp_seconds(F.floor(F.unix_seconds("et") / F.lit(pane)) * F.lit(pane))
    return (events.where(F.col("mid").isNotNull() & F.col("et").isNotNull())
            .groupBy(at.alias("pane"), "mid", "evid",
                     F.when(coupon, F.col("uid")).alias("uid"),
                     F.when(coupon, F.col("itemid")).alias("itemid"))
            .agg(F.count("*").alias("n")))


def spread(counted: DataFrame, length: str = ALERT_WINDOW, slide: str = "1 minute") -> DataFrame:
    """Rows with a ``pane``, once per window that holds it, with the window instead."""
    size, step = seconds(length), seconds(slide)
    at = F.unix_seconds("pane")
    last = F.floor(at / F.lit(step)) * F.lit(step)
    more = F.floor((last - at + F.lit(size - gcd(size, step))) / F.lit(step))
    others = [c for c in counted.columns if c != "pane"]
    start = F.explode(F.transform(
        F.when(more >= 0, F.sequence(F.lit(0).cast("bigint"), more)),
        lambda k: last - k * step)).alias("start")
    return counted.select(start, *others).select(
        F.timestamp_seconds("start").alias("window_start"),
        F.timestamp_seconds(F.col("start") + size).alias("window_end"), *others)


def windowed(events: DataFrame, length: str = ALERT_WINDOW, slide: str = "1 minute") -> DataFrame:
    """Counted events: each pane once per window it falls into."""
    return spread(panes(events, length, slide), length, slide)


def judge(counted: DataFrame, min_users: int = ALERT_MIN_USERS) -> DataFrame:
    """(window_start, window_end, mid, n_users, n_items, n_events, clicked) of the windows with
    enough coupon users; those nobody clicked in are alerts."""
    coupon = F.col("evid") == COUPON_EVENT
    return (counted.groupBy(*WINDOW_KEY)
            .agg(F.count_distinct("uid").alias("n_users"),
                 F.count_distinct(F.when(coupon, F.col("itemid"))).alias("n_items"),
                 F.sum(F.when(F.col("evid").isNotNull(), F.col("n")).otherwise(0)).alias("n_events"),
                 F.coalesce(F.max(F.col("evid") == CLICK_EVENT), F.lit(False)).alias("clicked"))
            .where(F.col("n_users") >= min_users))


def detect(counted: DataFrame, min_users: int = ALERT_MIN_USERS) -> DataFrame:
    """The alerting windows, with their counts."""
    return judge(counted, min_users).where(~F.col("clicked")).drop("clicked")


def minute_of(ts):
    return F.floor(F.unix_millis(ts) / F.lit(60000))


def last_of_minute(alerts: DataFrame) -> DataFrame:
    """Of several alerting windows that end in one minute only the last stays:
    they share a document id and the last write wins."""
    keyed = alerts.withColumn("_minute", minute_of(F.col("window_end")))
    last = (keyed.groupBy("mid", "_minute")
            .agg(F.max("window_end").alias("window_end")))
    return alerts.join(last.drop("_minute"), ["mid", "window_end"], "left_semi")


def members(counted: DataFrame, alerts: DataFrame) -> DataFrame:
    """(window_start, window_end, mid, kind, value, n): what alerts list.

    One row per different user, item and event name of an alerting window,
    with the number of events behind it.
    """
    listed = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("uid").alias("value")),
        F.struct(F.lit("item").alias("kind"), F.col("itemid").alias("value")),
        F.struct(F.lit("event").alias("kind"), F.col("evid").alias("value")))
    return (counted.join(alerts.select(*WINDOW_KEY), WINDOW_KEY, "left_semi")
            .select(*WINDOW_KEY, F.inline(listed), "n")
            .where(F.col("value").isNotNull())
            .groupBy(*WINDOW_KEY, "kind", "value").agg(F.sum("n").alias("n")))


def _named(rows: DataFrame) -> DataFrame:
    """Add the document id (one per device and minute), ``ts`` and the index day."""
    return rows.withColumns({
        "doc_id": F.concat_ws("-", F.col("mid"), minute_of(F.col("window_end")).cast("string")),
        "ts": F.unix_millis("window_end"), "index_day": day_of(F.col("window_end"))})


def alert_documents(alerts: DataFrame) -> DataFrame:
    """Headers (:data:`tidemart.schemas.ALERT_DOC`), one document id per minute."""
    return _named(last_of_minute(alerts)).select(*ALERT_DOC.fieldNames())


def alert_members(counted: DataFrame, alerts: DataFrame) -> DataFrame:
    """Member rows (:data:`tidemart.schemas.ALERT_MEMBER`) of the same documents.

    ``alerts`` is best a written table: it is small as a rule, and Spark can
    then see that and spare the events a shuffle.
    """
    return named_members(members(counted, last_of_minute(alerts)))


def alert_events(events: DataFrame, alerts: DataFrame, length: str = ALERT_WINDOW) -> DataFrame:
    """(doc_id, seq, ts, evid): all events of an alert in the order they happened, from 1 on.

    ``events`` has mid, evid, ts, the event time ``et`` and an ``id`` that tells events of one
    millisecond apart. Events meet windows in stretches of time as long as a window, of which a window
    touches two, so no event is spread over windows it is not listed in. Places are counted per
    document and sixteenth of a window and then within it: the events of a device that has a third of
    them all are still ranked by many tasks.
    """
    size = seconds(length)
    stretch, part = (lambda at, n=n: F.floor(F.unix_seconds(at) / F.lit(n)) for n in (size, max(size // 16, 1)))
    docs = _named(last_of_minute(alerts)).select(
        "doc_id", "mid", "window_start", "window_end", F.explode(F.array_distinct(F.array(
            stretch("window_start"), stretch(F.col("window_end") - F.expr("INTERVAL 1 SECOND"))))).alias("stretch"))
    named = events.where(F.col("evid").isNotNull()).select("mid", "evid", "ts", "et", "id", stretch("et").alias("stretch"))
    listed = (named.join(docs, ["mid", "stretch"])
              .where((F.col("et") >= F.col("window_start")) & (F.col("et") < F.col("window_end")))
              .select("doc_id", part("et").alias("part"), "ts", "evid", "id"))
    parts = listed.groupBy("doc_id", "part").agg(F.count("*").alias("n"))  # sixteen rows a document or so
    upto = Window.partitionBy("doc_id").orderBy("part")
    before = parts.select("doc_id", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("ts", "id"))
    return (listed.withColumn("place", within).join(before, ["doc_id", "part"])
            .select("doc_id", (F.col("before") + F.col("place")).alias("seq"), "ts", "evid"))


def named_members(listed: DataFrame) -> DataFrame:
    return _named(listed).select(*ALERT_MEMBER.fieldNames())


def latest_windows(versions: DataFrame) -> DataFrame:
    """Of the judged windows that batches wrote again and again, the last state of each; those
    that alert. ``run`` and ``batch`` tell which batch wrote it."""
    rows = last_per_key(versions, WINDOW_KEY, "batch")
    return last_of_minute(rows.where(~F.col("clicked")))
