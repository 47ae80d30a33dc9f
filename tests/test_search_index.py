"""Keyword postings and facet cells against plain search over all rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidemart.operators import cells, keywords, search
from tidemart.sinks import tables

NAMES = ["Ring", "gold RING", "Größe", "ab", "a", "", "aaaa", "😀😀😀x", "ring ring", "earring", None]


def sales_frame(spark, pairs):
    return spark.createDataFrame([(str(n), s, name) for n, (s, name) in enumerate(pairs)],
                                 "order_detail_id string, sku_id string, sku_name string")


def test_postings_equal_a_search_of_all_names(spark, tmp_path):
    rnd = random.Random(2)
    pairs = [(rnd.choice(["1", "2", None]), rnd.choice(NAMES)) for _ in range(80)]
    path = str(tmp_path / "names")
    keywords.begin(spark, path)
    assert keywords.sales_with(sales_frame(spark, pairs), path, "ring").count() == 0
    parts = [pairs[:30], pairs[20:60], pairs[60:]]
    for batch, part in enumerate(parts):
        keywords.index_names(sales_frame(spark, part), path, "s", batch)
        if batch == 1:
            keywords.fold(spark, path)
    frame = sales_frame(spark, pairs)

    def check():
        for word in ("r", "in", "RING", "ing", "g r", "aaa", "aaaaa", "ÖSSE", "größe", "😀😀", "😀x", "%", "", None):
            got = sorted(r[0] for r in keywords.sales_with(frame, path, word).collect())
            want = [str(n) for n, (_, name) in enumerate(pairs)
                    if not word or name is not None and word.lower() in name.lower()]
            assert got == sorted(want), word

    check()
    # a batch that is repeated, and one without any new name, leave the index as it was
    held = tables.read_days(spark, f"{path}/names", keywords.NAMES, "bucket", None, "bucket").count()
    keywords.index_names(sales_frame(spark, parts[2]), path, "s", 2)
    keywords.index_names(frame, path, "s", 3)
    assert tables.read_days(spark, f"{path}/names", keywords.NAMES, "bucket", None, "bucket").count() == held
    check()


def test_a_keyword_opens_its_own_buckets_and_no_text_of_the_sales(spark, tmp_path):
    path = str(tmp_path / "names")
    pairs = [(str(i), f"product {i * 7919:x} thing") for i in range(300)]
    frame = sales_frame(spark, pairs)
    frame.write.parquet(str(tmp_path / "sales"))
    keywords.index_names(frame, path, "s", 0)
    found = keywords.names_with(spark, path, "duct")
    opened = {f.split("period=")[1][:3] for f in found.inputFiles()}
    assert 1 <= len(opened) <= 2  # two runs of three characters
    hits = keywords.sales_with(spark.read.parquet(str(tmp_path / "sales")), path, "duct")
    assert hits.count() == 300
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    sales_side = plan[:plan.index("Aggregate")]
    assert "LeftSemi" in sales_side and "Contains" not in sales_side and "CartesianProduct" not in plan


def version(key, day, gender, age, known, level, rt):
    return (key, day, gender, age, known, level, rt, hash((key, rt, gender)) % 1000)


def test_cells_of_batches_equal_the_cells_of_the_whole(spark, tmp_path):
    rnd = random.Random(5)
    layout = ("order_detail_id string, dt string, user_gender string, user_age int, age_known boolean, "
              "user_level string, joined_rt timestamp, row_hash bigint")
    rows = [[version(str(rnd.randrange(40)), rnd.choice(["2024-01-01", "2024-01-02"]), rnd.choice(["M", "F", None]),
                     rnd.choice([10, 25, 40]), rnd.random() < 0.8, rnd.choice(["a", "b", None]), rnd.randrange(50))
             for _ in range(40)] for _ in range(4)]
    held, whole = None, []
    path = str(tmp_path / "cells")
    tables.make_folder(spark, path)
    for batch in (0, 1, 2, 3, 3):  # the last one is repeated
        fresh = spark.createDataFrame([(*r[:6], None, r[7]) for r in rows[batch]], layout).drop("joined_rt").join(
            spark.createDataFrame([(r[0], r[7], r[6]) for r in rows[batch]], "k string, h bigint, s int").distinct(),
            (F.col("k") == F.col("order_detail_id")) & (F.col("h") == F.col("row_hash"))).withColumn(
            "joined_rt", F.timestamp_seconds(F.col("s"))).drop("k", "h", "s").distinct()
        before = fresh.withColumn("batch", F.lit(0).cast("bigint")).limit(0) if held is None else held
        tables.write_days(cells.changes(fresh, before.where(F.col("batch") < batch), batch), path, "dt", "s", batch)
        if len(whole) == batch:
            whole.append(fresh.withColumn("batch", F.lit(batch).cast("bigint")))
            held = whole[0] if len(whole) == 1 else held.unionByName(whole[-1])
    last = cells.last_per_key(held, cells.KEY, "joined_rt", "batch", "row_hash", total=True)
    for level in (None, "a"):
        for days in (None, ["2024-01-02"]):
            want = last if days is None else last.where(F.col("dt").isin(days))
            want = search.facet_cells(want if level is None else want.where(F.col("user_level") == level))
            got = cells.total_of(tables.read_days(spark, path, cells.CELLS, "dt", days), level)
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
