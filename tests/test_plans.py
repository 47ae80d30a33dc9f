"""The plans are the ones meant to run on large inputs."""

import contextlib

import pytest
from oracle_check import rows
from pyspark.sql import functions as F

from tidemart.operators import alerts, devices, sales
from tidemart.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(spark, **more):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                    spark__sql__adaptive__autoBroadcastJoinThreshold="-1", **more)


@pytest.mark.parametrize("name", BATCH)
def test_no_python_rows_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEval", "InPandas", "InArrow", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert word not in text


def test_day_range_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["dau_total"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in text
    text = plan(QUERIES["gmv_total_by_day"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate" in text
    with settings(spark, spark__sql__maxMetadataStringLength="1000"):
        text = plan(QUERIES["gmv_hours_compare"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-14" in text
    assert "EqualTo(event_type,purchase)" in text and text.count("FileScan parquet") == 1


def test_first_rows_are_limited_before_the_shuffle(spark):
    text = plan(QUERIES["dau_first_of_day"](spark, SF))
    assert "Partial" in text.split("Exchange")[1] and text.count("WindowGroupLimit") == 2


def test_counts_combine_on_the_map_side(spark):
    text = plan(QUERIES["dau_by_hour"](spark, SF))
    assert "partial_min(et" in text and "SortAggregate" not in text
    assert text.count("Exchange") == 2


def test_alert_users_are_counted_in_two_steps(spark):
    text = plan(QUERIES["coupon_alert"](spark, SF))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert any("uid#" in line for line in exchanges)


def test_json_is_parsed_once(spark):
    assert plan(QUERIES["parse_start_log"](spark, SF)).split("DataFilters")[0].count(
        "from_json(") == 1


def test_order_lines_are_shuffled_once(spark):
    with shuffled(spark):
        text = plan(QUERIES["sale_detail_enriched"](spark, SF))
    by_order = [line for line in text.splitlines()
                if "Exchange hashpartitioning(order_id" in line]
    by_user = [line for line in text.splitlines() if "Exchange hashpartitioning(user_id" in line]
    assert len(by_order) == 2 and len(by_user) == 2


def test_province_report_joins_after_summing_per_user(spark):
    with shuffled(spark):
        text = plan(QUERIES["sales_by_province"](spark, SF))
    assert sum("Exchange hashpartitioning(user_id" in x for x in text.splitlines()) == 2
    assert "partial_sum(cast(total_amount" in text


def test_pages_take_ordered(spark):
    assert "TakeOrderedAndProject(limit=40" in plan(QUERIES["search_page"](spark, SF))


def test_seen_devices_use_the_placing_of_the_batch(spark):
    with shuffled(spark):
        text = plan(QUERIES["dau_anti_seen"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 2


def hot_lines(spark):
    """Order lines of which a third belongs to one order."""
    base = spark.range(60_000, numPartitions=4)
    oid = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000)
    return base.select(
        F.col("id").cast("string").alias("id"), oid.cast("string").alias("order_id"),
        F.lit("s").alias("sku_id"), F.lit(9.5).alias("order_price"),
        F.sha2(F.col("id").cast("string"), 512).alias("sku_name"),
        F.timestamp_seconds(F.lit(1000)).alias("rt"))


def hot_orders(spark):
    return spark.range(2500, numPartitions=2).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("order_status"),
        F.lit("2024-01-01 00:00:00").alias("create_time"), F.lit("u").alias("user_id"),
        F.lit("2024-01-01").alias("create_date"), F.timestamp_seconds(F.lit(1000)).alias("rt"))


@pytest.mark.parametrize("join", [sales.join_lines, sales.full_outer_lines, sales.interval_join])
def test_a_hot_order_is_split_over_tasks(spark, join):
    with shuffled(spark, spark__sql__shuffle__partitions="20",
                  spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
                  spark__sql__adaptive__advisoryPartitionSizeInBytes="64k"):
        df = join(hot_orders(spark), hot_lines(spark))
        found = df.collect()
        text = plan(df)
    assert len(found) == 60_000 + (500 if join is sales.full_outer_lines else 0)
    assert "SortMergeJoin(skew=true)" in text


def test_a_hot_device_does_not_reach_one_task_unreduced(spark):
    """A third of all start logs from one device: one row per map task is shuffled."""
    logs = spark.range(30_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("mid"),
        F.col("id").alias("ts"), F.lit("2024-01-01").alias("log_date"))
    df = devices.first_of_day(logs)
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert "WindowGroupLimit" in metrics
    assert rows(df.where("mid = 'hot'").select("ts")) == [(0,)]


def test_panes_are_counted_before_they_are_spread(spark):
    text = plan(QUERIES["coupon_alert_fine"](spark, SF))
    spread, counted = text.index("Generate explode"), text.index("partial_count(1)")
    assert spread < counted  # plans read from the result down


def test_one_day_of_orders_is_pushed_to_the_scan(spark):
    for name in ("gmv_total_one_day", "search_by_day"):
        text = plan(QUERIES[name](spark, SF))
        pushed = [x.split("PushedFilters")[1] for x in text.splitlines() if "PushedFilters" in x]
        assert any("orderdate,1998-03-02T00:00)" in x for x in pushed), pushed


def test_change_routing_does_not_join_parts(spark):
    assert "Join" not in plan(QUERIES["cdc_routing"](spark, SF))
