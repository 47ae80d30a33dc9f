"""Keyword search over product names through posting lists of trigrams.

Two tables beside the sales, both grown by batches and read by bucket:

* *names*: every different (sku_id, sku_name) once per batch that brought it first, bucketed by both;
* *postings*: one row per name and run of three characters of it, bucketed by that run.

A keyword of three characters or more opens the buckets of its own runs, keeps the names that hold
all of them, and checks these for the keyword itself; a shorter one is looked for in the names
table. The sales are then read by the names that were found: no text of them is searched.

Defined cases: the case of letters does not count; an empty keyword or None finds everything; a NULL
name is found by none; a NULL sku_id is a value like another; characters are code points. A repeated
batch writes its own rows again; repeated names change nothing, as both tables are read as sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.sinks import tables

GRAM = 3
BUCKETS = 32
NAME = ("sku_id", "sku_name")
_NAME_FIELDS = [T.StructField(n, T.StringType()) for n in NAME]
NAMES = T.StructType([*_NAME_FIELDS, T.StructField("bucket", T.StringType())])
POSTINGS = T.StructType([T.StructField("gram", T.StringType()), *NAMES.fields])


def grams(text: Column) -> Column:
    """The different runs of three characters of a text, in lower case; none if it is shorter."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(low) - (GRAM - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))
    return F.when(F.char_length(low) >= GRAM, runs).otherwise(F.array().cast("array<string>"))


def _bucket(*columns: Column | str) -> Column:
    return F.lpad(F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("string"), 3, "0")


def _names_path(path: str) -> str:
    return f"{path}/names"


def _postings_path(path: str) -> str:
    return f"{path}/postings"


def begin(spark: SparkSession, path: str) -> None:
    """An index without names, so that it can be asked before there are sales."""
    for part in (_names_path(path), _postings_path(path)):
        tables.make_folder(spark, part)


def index_names(sales: DataFrame, path: str, run: str, batch: int) -> None:
    """Add the names of a batch of sales that the index does not hold yet.

    The batch is compared with the buckets its own names fall into. What this batch itself left at an
    earlier attempt does not count as held: it is about to be replaced.
    """
    spark = sales.sparkSession
    begin(spark, path)
    fresh = (sales.where(F.col("sku_name").isNotNull()).select(*NAME).distinct()
             .withColumn("bucket", _bucket(*NAME)).persist())
    try:
        buckets = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # BUCKETS at most
        held = tables.read_days(spark, _names_path(path), NAMES, "bucket", buckets, "bucket")
        held = held.where((F.col("run") != run) | (F.col("batch") < int(batch))).select(
            *(F.col(n).alias(f"held_{n}") for n in NAME))
        same = [F.col(n).eqNullSafe(F.col(f"held_{n}")) for n in NAME]
        new = fresh.join(held, same[0] & same[1], "left_anti")
        postings = new.select(F.explode(grams(F.col("sku_name"))).alias("gram"), *NAME).withColumn(
            "bucket", _bucket("gram"))
        # names last: a name counts as held only once its postings are there
        tables.write_days(postings, _postings_path(path), "bucket", run, batch, "bucket", "gram")
        tables.write_days(new, _names_path(path), "bucket", run, batch, "bucket", *NAME)
    finally:
        fresh.unpersist()


def fold(spark: SparkSession, path: str) -> None:
    """Replace the batches of both tables by one snapshot a bucket, each row once."""
    tables.fold_days(spark, _names_path(path), NAMES, "bucket", None, ["bucket", *NAME], (), "bucket")
    tables.fold_days(spark, _postings_path(path), POSTINGS, "bucket", None, ["bucket", "gram", *NAME], (),
                     "bucket")


def names_with(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """The (sku_id, sku_name) whose name holds ``keyword``."""
    wanted = F.lower(F.lit(keyword))
    holds = F.contains(F.lower("sku_name"), wanted)
    whole = spark.range(1)  # the keyword is cut by the same expressions as the names
    runs = whole.select(F.explode(grams(F.lit(keyword))).alias("gram")).select(
        "gram", _bucket("gram").alias("bucket")).collect()
    if not runs:
        rows = tables.read_days(spark, _names_path(path), NAMES, "bucket", None, "bucket")
        return rows.where(holds).select(*NAME).distinct()
    rows = tables.read_days(spark, _postings_path(path), POSTINGS, "bucket",
                            sorted({r["bucket"] for r in runs}), "bucket")
    rows = rows.where(F.col("gram").isin([r["gram"] for r in runs]) & holds)
    return (rows.select("gram", *NAME).distinct().groupBy(*NAME).agg(F.count("*").alias("n"))
            .where(F.col("n") == len(runs)).select(*NAME))


def sales_with(sales: DataFrame, path: str, keyword: str | None) -> DataFrame:
    """The sales whose product name holds ``keyword``, by the index at ``path``."""
    if not keyword:
        return sales
    found = names_with(sales.sparkSession, path, keyword)
    found = found.select(*(F.col(n).alias(f"found_{n}") for n in NAME))
    same = [F.col(n).eqNullSafe(F.col(f"found_{n}")) for n in NAME]
    return sales.join(found, same[0] & same[1], "left_semi")
