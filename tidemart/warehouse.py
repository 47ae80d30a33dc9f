"""The whole warehouse below one root folder: jobs that fill it, queries that serve it.

    house = Warehouse(spark, "hdfs:///warehouse")
    house.route_changes(changes)          # streams in
    house.count_devices(); house.count_orders(); house.join_sales()
    house.totals("2024-01-15")            # answers out

Every job may run continuously or, with ``trigger=ONCE``, catch up and stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemart.functions.columns import event_time, previous_day
from tidemart.operators import cells, devices, keywords, orders, search, serving
from tidemart.schemas import DAU_TABLE, FEEDS, SALE_DETAIL
from tidemart.sinks import tables
from tidemart.sources import feeds
from tidemart.streaming import jobs


class Warehouse:
    """Tables and progress of all jobs under ``root``.

    ``sources`` maps a feed name to its raw stream. A feed that is not in it
    is read from the topic files the routers write below ``root``.
    """

    def __init__(self, spark: SparkSession, root: str,
                 sources: dict[str, DataFrame] | None = None, period: str = "day"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.sources = sources or {}
        self.period = period

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _feed(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name]
        topic = FEEDS[name].topic
        tables.make_folder(self.spark, self.path(f"topics/topic={topic}"))  # may be empty yet
        return feeds.read_topic_stream(self.spark, self.path("topics"), topic)

    def _table(self, name: str) -> str:
        """The path of an own table, which may have no rows yet; a root without any job is an
        error."""
        if not tables.exists(self.spark, self.path("progress")):
            raise FileNotFoundError(f"no warehouse at {self.root}")
        tables.make_folder(self.spark, self.path(name))
        return self.path(name)

    def _places(self, job: str) -> dict[str, str]:
        return {"checkpoint": self.path(f"progress/{job}"),
                "quarantine": self.path(f"quarantine/{job}")}

    # --- jobs -----------------------------------------------------------------

    def route_logs(self, raw: DataFrame, trigger: dict | None = None,
                   **sink: str) -> StreamingQuery:
        return jobs.start_log_router(raw, self.path("topics"), self.path("archive"),
                                     trigger=trigger, **self._places("logs"), **sink)

    def route_changes(self, changes: DataFrame, trigger: dict | None = None,
                      **sink: str) -> StreamingQuery:
        return jobs.start_change_router(changes, self.path("topics"), trigger=trigger,
                                        **self._places("changes"), **sink)

    def count_devices(self, trigger: dict | None = None) -> StreamingQuery:
        return jobs.start_dau(self._feed("start"), self.path("dau"), trigger=trigger,
                              **self._places("dau"))

    def time_devices(self, trigger: dict | None = None) -> StreamingQuery:
        """Active devices by their earliest record; :meth:`active_devices` answers from it."""
        return jobs.start_dau_state(self._feed("start"), self.path("active"), trigger=trigger,
                                    **self._places("active"))

    def watch_coupons(self, trigger: dict | None = None, **rule) -> StreamingQuery:
        return jobs.start_alerts(self._feed("event"), self.path("alerts"), trigger=trigger,
                                 **self._places("alerts"), **rule)

    def count_orders(self, trigger: dict | None = None) -> StreamingQuery:
        return jobs.start_gmv(self._feed("order"), self.path("orders"), period=self.period,
                              trigger=trigger, **self._places("orders"))

    def keep_users(self, trigger: dict | None = None) -> StreamingQuery:
        return jobs.start_users(self._feed("user"), self.path("users"), trigger=trigger,
                                **self._places("users"))

    def fold_users(self) -> None:
        """Bound what the user dimension reads; once a day or so."""
        jobs.fold_users(self.spark, self._table("users"))

    def join_sales(self, trigger: dict | None = None, **join) -> StreamingQuery:
        """The joined sales; the job sets the unreadable records of both feeds aside itself."""
        return jobs.start_sale_details(
            self._feed("order"), self._feed("order_detail"), self.path("users"),
            self.path("sales"), period=self.period, trigger=trigger, served=True, **self._places("sales"),
            **join)

    def close_feeds(self, before: str) -> None:
        """End the receive days before ``before`` in the buffer of the sales join."""
        jobs.close_feeds(self.spark, self._table("sales"), before)

    def late_sales(self) -> DataFrame:
        """(rt_day, feed, n) of the rows that came for closed receive days."""
        return jobs.late_rows(self.spark, self._table("sales"))

    def replay_late_sales(self, **join) -> None:
        """Join the late rows after all; may be repeated."""
        jobs.replay_late(self.spark, self._table("sales"), self._table("users"), period=self.period, served=True,
                         **join)

    def fold_keywords(self) -> None:
        """Bound what the keyword index reads; once a day or so."""
        keywords.fold(self.spark, self._names())

    def set_aside(self, feed: str, trigger: dict | None = None) -> StreamingQuery:
        """Keep the unreadable records of a feed that only joins or windows use."""
        return jobs.start_quarantine(self._feed(feed), feed, trigger=trigger,
                                     **self._places(f"{feed}-feed"))

    def close_day(self, day: str) -> None:
        """Once a day is over: keep its new devices and fold its batches into one snapshot a table,
        which all answers read from then on, with what came after it.

        Days are closed in order. Repeating a day gives the same answers.
        """
        fresh = self.new_devices([day])
        (fresh.hint("rebalance").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("log_date")
         .parquet(self.path("first_seen")))
        for name, schema, column, keys, order in (
                ("orders", jobs.ORDER_VERSIONS, "create_date", ["id"], ["change_ts"]),
                ("sales", jobs.SALE_VERSIONS, "dt", ["order_detail_id"], ["joined_rt"]),
                ("sales_cells", cells.CELLS, "dt", [], []),
                ("dau", DAU_TABLE, "log_date", [], []),
                ("alerts/panes", jobs.PANES, "pane_day", [], []),
                ("alerts/windows", jobs.JUDGED, "index_day", [], []),
                ("alerts/members", jobs.LISTED, "index_day", [], [])):
            period = self.period if keys or column == "dt" else "day"
            tables.fold_days(self.spark, self._table(name), schema, column, [day],
                             [*keys, column] if keys else [], order, period)

    # --- tables ---------------------------------------------------------------

    def devices_of(self, days: list[str] | None = None) -> DataFrame:
        return tables.read_days(self.spark, self._table("dau"), DAU_TABLE, "log_date", days).drop(
            *tables.BATCH_COLUMNS)

    def active_devices(self, days: list[str] | None = None) -> DataFrame:
        return jobs.active_devices(self.spark, self._table("active"), days)

    def new_devices(self, days: list[str]) -> DataFrame:
        """Devices of the given days that no earlier day has seen.

        Compares the days with the first-seen table of the days closed before
        them, which has one row per device, not with the whole activity.
        """
        first = min(days)
        seen = tables.read_table(self.spark, self._table("first_seen"),
                                 "mid STRING, log_hour STRING, log_date STRING")
        rows = self.devices_of(days).withColumn("et", event_time(F.col("ts")))
        earlier = seen.where(F.col("log_date") < first).select("mid")
        return devices.new_devices(rows.join(earlier, "mid", "left_anti"), "et")

    def orders_of(self, days: list[str] | None = None) -> DataFrame:
        return jobs.current_orders(self.spark, self._table("orders"), days, self.period)

    def users(self) -> DataFrame:
        return jobs.current_users(self.spark, self._table("users"))

    def sales_of(self, days: list[str] | None = None) -> DataFrame:
        return jobs.current_sales(self.spark, self._table("sales"), days, self.period).select(
            *SALE_DETAIL.fieldNames())

    def alerts_of(self, days: list[str] | None = None) -> DataFrame:
        return jobs.current_alerts(self.spark, self._alerts(), days)

    def alert_members_of(self, days: list[str] | None = None) -> DataFrame:
        return jobs.current_alert_members(self.spark, self._alerts(), days)

    def _names(self) -> str:
        path = jobs.names_of(self._table("sales"))
        keywords.begin(self.spark, path)
        return path

    def sales_cells(self, days: list[str] | None = None, level: str | None = None) -> DataFrame:
        """Sales per gender and age class, as the sales job keeps them."""
        self._table("sales_cells")
        return jobs.current_cells(self.spark, self._table("sales"), days, level, self.period)

    def _alerts(self) -> str:
        for part in ("windows", "members"):
            self._table(f"alerts/{part}")
        return self.path("alerts")

    # --- answers --------------------------------------------------------------

    def totals(self, day: str) -> DataFrame:
        """The three totals of a day as (id, name, value)."""
        return serving.totals_card(self.devices_of([day]), self.new_devices([day]),
                                   self.orders_of([day]), day)

    def totals_json(self, day: str) -> DataFrame:
        return serving.totals_payload(self.totals(day))

    def _two_days(self, day: str) -> dict[str, DataFrame]:
        days = [previous_day(day), day]
        return {"dau": self.devices_of(days), "new_mids": self.new_devices(days),
                "orders": self.orders_of(days)}

    def hours(self, metric: str, day: str) -> DataFrame:
        """(hour, yesterday, today) over all 24 hours; nothing for an unknown metric."""
        return serving.metric_hours(self.spark, metric, day, **self._two_days(day))

    def hours_json(self, metric: str, day: str) -> DataFrame:
        return serving.hours_payload(serving.metric_rows(metric, day, **self._two_days(day)))

    def search(self, day: str | None = None, keyword: str | None = None,
               level: str | None = None, page: int = 1, size: int = 10) -> search.SearchResult:
        """A keyword is looked up in the index; without one, total and facets come from the kept cells."""
        days = [day] if day else None
        sales = keywords.sales_with(self.sales_of(days), self._names(), keyword)
        kept = None if keyword else self.sales_cells(days, level)
        return search.search(sales, day, None, level, page, size, kept)

    def search_json(self, **query) -> DataFrame:
        return search.response(self.search(**query))

    def provinces(self, names: DataFrame, days: list[str] | None = None) -> DataFrame:
        """Orders and order value per province; ``names`` has province_id and province_name."""
        return orders.order_sales_by_province(self.orders_of(days), names)
