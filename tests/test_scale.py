"""What a job costs as its input grows: rows shuffled once, narrow caches, several input files."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemart.functions.parse import good, parse_changes, quarantined
from tidemart.operators import cells, keywords, routing, sales, search
from tidemart.plans import queries as Q
from tidemart.session import FIRST_PARTITIONS, brief_shuffles, prepare
from tidemart.sinks import tables
from tidemart.streaming import jobs

HEADS = "id string, order_status string, create_time string, user_id string, create_date string, rt timestamp, fresh boolean"
LINES = "order_id string, id string, sku_id string, order_price string, sku_name string, rt timestamp, fresh boolean"


def times(spark, rows, layout, at):
    return spark.createDataFrame(rows, layout.replace("rt timestamp", "rt int")).withColumn(
        "rt", F.timestamp_seconds(F.lit(1_699_920_100) + F.col(at)))


def test_one_join_finds_the_pairs_with_a_fresh_row(spark):
    heads = times(spark, [(k, "O", "t", "u", "d", rt, fresh) for k, rt, fresh in (
        ("1", 0, True), ("1", 50, False), ("2", 0, False), ("3", 0, True), (None, 0, True))], HEADS, "rt")
    lines = times(spark, [(k, f"l{n}", "s", "1.5", "x", rt, fresh) for n, (k, rt, fresh) in enumerate((
        ("1", 10, True), ("1", 10, False), ("1", 101, False), ("2", 5, True), ("2", 5, False),
        ("3", 200, True), (None, 0, True)))], LINES, "rt")
    got = sales.interval_join(heads, lines, 100, fresh="fresh")
    new, old = F.col("fresh"), ~F.col("fresh")
    want = sales.interval_join(heads.where(new), lines, 100).unionByName(
        sales.interval_join(heads.where(old), lines.where(new), 100))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.count() == 4


def test_orders_of_a_batch_are_not_repeated_and_users_meet_them_before_the_lines(spark, tmp_path, monkeypatch):
    plans, kept = [], jobs._SalesJoin._keep
    monkeypatch.setattr(jobs._SalesJoin, "_keep", lambda self, pairs, *a: (
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()), kept(self, pairs, *a)))
    table, users = str(tmp_path / "sales"), str(tmp_path / "users")
    for path in (users, *jobs._feed_tables(table), table):
        tables.make_folder(spark, path)
    spark.createDataFrame([], jobs.USER_VERSIONS).withColumns({
        "run": F.lit("u"), "batch": F.lit(0)}).write.mode("append").partitionBy("run", "batch").parquet(users)
    heads = times(spark, [("1", "O", "t", "u", "2024-01-01", 0, True)], HEADS, "rt").withColumn("rt_day", F.lit("2023-11-14"))
    lines = times(spark, [("1", "l", "s", "1.5", "x", 5, True)], LINES, "rt").withColumn("rt_day", F.lit("2023-11-14"))
    join = jobs._SalesJoin(users, table, "2024-06-01", 100, 1, "day")
    join.write(heads.select(*jobs.SALE_ORDERS.fieldNames()), lines.select(*jobs.SALE_LINES.fieldNames()), "a", 0)
    assert jobs.current_sales(spark, table).count() == 1
    assert plans[0].count("Join Inner") == 1 and "salt" not in plans[0]


def test_shuffles_begin_with_many_partitions(spark):
    number = int(prepare(spark).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    assert number >= FIRST_PARTITIONS == 400


def test_folding_shuffles_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select(F.pmod("id", F.lit(300)).cast("string").alias("k"), F.col("id").alias("v"),
                                    F.concat(F.lit("2024-0"), F.pmod("id", F.lit(3)) + 1, F.lit("-01")).alias("day"))
    for batch in (0, 1):
        tables.write_days(rows.withColumn("v", F.col("v") + batch), path, "day", "a", batch, "month")
    tables.fold_days(spark, path, rows.schema, "day", None, ["k", "day"], ["v"], "month")
    folded = spark.read.parquet(f"{path}_folded/fold=00000000").drop("run", "batch", "period")
    want = rows.groupBy("k", "day").agg((F.max("v") + 1).alias("v"))
    assert sorted(map(tuple, folded.select("k", "day", "v").collect())) == sorted(map(tuple, want.collect()))
    placed = rows.withColumn("period", F.substring("day", 1, 7)).repartitionByRange("period", "day", "k")
    plan = tables.last_per_key(placed, ["period", "day", "k"], "v").sortWithinPartitions(
        "period", "day", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_whose_number_is_told_are_written_without_a_shuffle(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(40).repartition(8).select(F.col("id"), F.lit("2024-01-01").alias("day"))
    tables.write_days(rows, path, "day", "a", 0, n_rows=40)
    read = tables.read_days(spark, path, rows.schema, "day")
    assert read.count() == 40 and len(read.inputFiles()) == 1


@pytest.mark.parametrize("held", [False, True])
def test_cells_with_null_keys(spark, held):
    layout = ("order_detail_id string, dt string, user_gender string, user_age int, age_known boolean, user_level string, "
              "joined_rt timestamp, row_hash bigint, batch bigint")
    old = [(None, "d", "M", 10, True, "a", None, 1, 0), ("1", None, "F", 25, True, None, None, 1, 0),
           ("9", "d", "F", 25, True, None, None, 1, 0)] if held else []
    new = [(None, "d", "F", 40, True, "a", None, 2, 1), ("1", None, "F", 25, False, None, None, 0, 1),
           ("2", "d", None, None, False, "b", None, 0, 1)]
    old, new = spark.createDataFrame(old, layout), spark.createDataFrame(new, layout)
    got = cells.changes_of(cells.newest(new.drop("batch"), 1), old)

    def counted(rows, n):
        last = cells.last_per_key(rows, cells.KEY, "joined_rt", "batch", "row_hash", total=True)
        return last.select("dt", "user_level", search.gender_class(), search.age_class(), F.lit(n))

    both = counted(old, -1).collect() + counted(old.unionByName(new), 1).collect()
    want = Counter()
    for *cell, n in both:
        want[tuple(cell)] += n
    assert {tuple(r)[:4]: r.n for r in got.collect()} == {c: n for c, n in want.items() if n}


def test_kept_changes_are_narrow_and_split_as_before(spark):
    event = '{"entry_type":"%s","table":"%s","op":"%s","after":{"id":"1"}}'
    texts = [event % ("ROWDATA", "order_info", "INSERT"), event % ("ROWDATA", "sku_info", "INSERT"), "{", None,
             event % ("TRANSACTIONEND", "order_info", "INSERT"), event % ("ROWDATA", "user_info", "UPDATE")]
    raw = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    parsed = parse_changes(raw)
    kept = routing.route_or_set_aside(parsed)
    assert kept.columns == ["topic", "value", "timestamp", "error"]
    fine = kept.where(F.col("error").isNull()).drop("error")
    assert sorted(map(str, fine.collect())) == sorted(map(str, routing.route_changes(good(parsed)).collect()))
    assert sorted(map(str, quarantined(kept).collect())) == sorted(map(str, quarantined(parsed).collect()))
    assert quarantined(kept).count() == 2


def test_input_files_of_the_streams(spark, tmp_path):
    raw = spark.range(90).repartition(3).select(
        F.col("id").cast("string").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"))
    assert Q._hours_as_stream(raw, str(tmp_path / "h"), 6, 0).isStreaming
    assert len(spark.read.parquet(str(tmp_path / "h")).inputFiles()) == 3


def test_a_file_of_start_logs_holds_whole_days(spark, tmp_path):
    (spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7200)
                             .cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
                             F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
     .write.parquet(str(tmp_path / "events.parquet")))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        Q._start_files(spark, str(tmp_path), str(tmp_path / "out"), (1, 10))
    finally:
        spark.conf.set(key, "true")
    rows = spark.read.parquet(str(tmp_path / "out/in")).select(F.to_date("timestamp").alias("day"), F.input_file_name().alias("file"))
    files = rows.groupBy("day").agg(F.count_distinct("file").alias("n")).collect()
    assert len(files) == 10 and {r.n for r in files} == {1}
    assert rows.select("file").distinct().count() > 1


def test_sales_are_joined_once_for_all_keywords(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(Q, "_sales", lambda *a: calls.append(a) or spark.createDataFrame(
        [("1997-01-01", "1", "gold ring"), ("1990-01-01", "2", "ring")], "dt string, sku_id string, sku_name string"))
    got = {r.keyword: r.total for r in Q.QUERIES["search_totals_indexed"](spark, "none").collect()}
    assert got["RING"] == 2 and len(got) == len(Q.KEYWORDS) and len(calls) == 1
    assert keywords.NAME == ("sku_id", "sku_name")


def sale_feeds(spark, tmp_path):
    """A sales join over new tables, with orders and lines of it."""
    table, users = str(tmp_path / "sales"), str(tmp_path / "users")
    for path in (users, *jobs._feed_tables(table), table):
        tables.make_folder(spark, path)
    spark.createDataFrame([], jobs.USER_VERSIONS).withColumns({
        "run": F.lit("u"), "batch": F.lit(0)}).write.mode("append").partitionBy("run", "batch").parquet(users)
    day = F.date_format("rt", "yyyy-MM-dd")
    heads = times(spark, [(str(n), "O", "t", "u", f"2024-0{1 + n % 3}-01", n, True) for n in range(60)], HEADS, "rt")
    lines = times(spark, [(str(n), f"l{n}", "s", "1.5", "x", n + 5, True) for n in range(60)], LINES, "rt")
    return (jobs._SalesJoin(users, table, "2024-06-01", 100, 1, "month"), heads.withColumn("rt_day", day).select(
        *jobs.SALE_ORDERS.fieldNames()), lines.withColumn("rt_day", day).select(*jobs.SALE_LINES.fieldNames()))


def test_sales_are_written_where_they_are_joined_and_nothing_is_held(spark, tmp_path, monkeypatch):
    plans, place = [], tables.place_days
    monkeypatch.setattr(tables, "place_days", lambda rows, path, *a, **k: (
        path.endswith("/sales") and plans.append(rows.withColumn("period", F.lit(1))), place(rows, path, *a, **k)))
    join, heads, lines = sale_feeds(spark, tmp_path)
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    join.write(heads, lines, "a", 0)
    assert jobs.current_sales(spark, join.table, period="month").count() == 60
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= held
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Rebalance" not in plan
    files = list((tmp_path / "sales").rglob("period=*/*.parquet"))
    assert {f.parent.name for f in files} == {"period=2024-01", "period=2024-02", "period=2024-03"}


def test_rows_around_a_batch_are_not_shuffled_to_find_them(spark, tmp_path, monkeypatch):
    join, heads, lines = sale_feeds(spark, tmp_path)
    join.write(heads.limit(0), lines, "a", 0)
    plans, around = [], jobs._SalesJoin.around

    def seen(self, *a):
        near = around(self, *a)
        if near is not None:
            plans.append(near._jdf.queryExecution().executedPlan().toString())
        return near

    monkeypatch.setattr(jobs._SalesJoin, "around", seen)
    join.write(heads, lines.limit(0), "a", 1)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "hashpartitioning(stretch" not in plans[0].split(
        "InMemoryTableScan")[0]
    assert jobs.current_sales(spark, join.table, period="month").count() == 60


def test_a_batch_is_read_only_once_it_is_committed(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(30).select(
        F.col("id"), F.concat(F.lit("2024-01-1"), F.col("id") % 3).alias("day"))
    tables.make_folder(spark, path)
    tables.place_days(rows, path, "day", "a", 0, as_made=True)
    assert tables.read_batch(spark, path, rows.schema, "a", 0).count() == 30
    assert tables.read_days(spark, path, rows.schema, "day").count() == 0
    assert tables.read_batch(spark, path, rows.schema, "a", 1).count() == 0
    tables.commit_days(spark, path, "a", 0)
    assert tables.read_days(spark, path, rows.schema, "day").count() == 30


def test_last_versions_are_not_chosen_again_after_a_fold(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k", "day"]
    layout = spark.createDataFrame([], "k string, v bigint, day string, row_hash bigint").schema

    def add(batch, rows):
        made = spark.createDataFrame([(*r, hash(r)) for r in rows], layout)
        tables.write_days(made, path, "day", "a", batch, "month")

    def last(days=None, order=("v",)):
        rows = tables.latest_days(spark, path, layout, "day", keys, list(order), days, "month")
        every = tables.latest(tables.read_days(spark, path, layout, "day", days, "month"), keys, *order)
        assert rows.columns == every.columns
        assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, every.collect()))
        return rows.count(), "Window" in rows._jdf.queryExecution().optimizedPlan().toString()

    add(0, [("a", 1, "2024-01-01"), ("a", 2, "2024-01-01"), (None, 1, "2024-02-01"), ("a", 1, "2024-02-01")])
    add(1, [("a", 3, "2024-01-01"), ("b", 1, "2024-01-02"), (None, 5, "2024-02-01")])
    assert last() == (4, True)
    tables.fold_days(spark, path, layout, "day", None, keys, ["v"], "month")
    assert last() == (4, False) and last(["2024-01-02"]) == (1, False)
    assert last(order=()) == (4, True)  # another order than that of the fold
    add(2, [("b", 7, "2024-01-02")])
    assert last() == (4, True) and last(["2024-02-01"]) == (2, False)
    tables.fold_days(spark, path, layout, "day", None, [], [], "month")
    assert last(["2024-01-01", "2024-01-02"]) == (2, True)  # this fold chose nothing
    tables.fold_days(spark, path, layout, "day", None, keys, ["v"], "month")
    assert last(["2024-02-01"]) == (2, False)


@pytest.mark.parametrize("n_days", [2, 12])
def test_a_fold_of_few_periods_needs_no_shuffle(spark, tmp_path, monkeypatch, n_days):
    together, fold = [], tables._fold_together
    monkeypatch.setattr(tables, "_fold_together", lambda *a: (together.append(1), fold(*a)))
    path, rows = str(tmp_path / "t"), spark.range(120).repartition(4).select(
        F.col("id"), F.concat(F.lit("2024-01-"), 10 + F.col("id") % n_days).alias("day"))
    for batch in (0, 1):
        tables.write_days(rows, path, "day", "a", batch)
    tables.fold_days(spark, path, rows.schema, "day")
    read = tables.read_days(spark, path, rows.schema, "day")
    assert read.count() == 240 and len(read.inputFiles()) == n_days
    assert all("_folded/" in f for f in read.inputFiles()) and len(together) == (n_days > 8)


def test_shuffle_files_of_streams_and_writes_are_brief(spark, drop_file, tmp_path):
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    with brief_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
    folder = drop_file("in", ['{"id":"1"}'])
    raw = Q.feeds.read_feed_stream(spark, None, "text", folder)
    jobs._start(raw, "brief", str(tmp_path / "progress"), jobs.ONCE, "1 second", lambda batch, run, n: seen.append(
        batch.sparkSession.conf.get(key))).awaitTermination()
    assert seen == ["true"] and spark.conf.get(key) == before


def test_cells_of_both_sides_are_shuffled_once_and_together(spark, tmp_path):
    layout = ("order_detail_id string, dt string, user_gender string, user_age int, age_known boolean, user_level string, "
              "joined_rt timestamp, row_hash bigint, batch bigint")
    sides = []
    for batch in (0, 1):
        rows = [(f"l{n}", f"2024-01-{10 + n % 20}", "M", 25, True, "ab"[batch], None, n, batch) for n in range(90)]
        spark.createDataFrame(rows, layout).write.parquet(str(tmp_path / f"{batch}"))
        sides.append(spark.read.parquet(str(tmp_path / f"{batch}")))
    got = cells.changes(sides[1].drop("batch"), sides[0], 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 2 and "Join" not in plan
    assert sum(r.n for r in got.where("user_level = 'b'").collect()) == 90
    assert sum(r.n for r in got.where("user_level = 'a'").collect()) == -90
