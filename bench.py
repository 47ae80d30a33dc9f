"""Time the headline queries and print one JSON line.

Each query is executed in full (results go to a sink that discards them) after
one untimed run of the first one, which starts the JVM side: the least of three
runs, and one run for the streaming jobs.
"""

from __future__ import annotations

import json
import os
import time

from tidemart.plans.queries import QUERIES
from tidemart.session import build_session

HEADLINE = [
    "dau_first_of_day", "dau_anti_seen", "dau_by_hour", "dau_hours_compare", "new_devices_by_day",
    "gmv_total_by_day", "gmv_by_hour", "gmv_hours_compare", "totals_card", "order_upsert_last",
    "sales_by_province", "coupon_alert", "alert_docs", "sale_detail_full_outer",
    "sale_detail_enriched", "sale_detail_interval", "user_latest", "search_page", "search_total",
    "facet_gender", "facet_age", "parse_start_log", "log_routing_counts", "cdc_routing",
]
#: Jobs from an empty table to its last record; timed once, as each run starts its own stream.
STREAMS = ["stream_dau", "stream_dau_state", "stream_gmv", "stream_users", "stream_alerts",
           "stream_sale_details"]
ROUNDS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run(HEADLINE[0])
    seconds = {name: round(min(run(name) for _ in range(ROUNDS)), 3) for name in HEADLINE}
    streams = {name: round(run(name), 3) for name in STREAMS}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "streams": streams,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
