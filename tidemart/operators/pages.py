"""Numbered pages of a large listing at constant cost.

An offset makes every task keep all rows up to the page. A listing that is read often is written once
in order instead, in parts of neighbouring rows, with a directory that says how many rows stand before
each part: any page then opens the one part, or the two, that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.operators.search import PAGE_ORDER

_DIRECTORY = "part INT, n BIGINT, before BIGINT"


def write_pages(rows: DataFrame, path: str, parts: int | None = None, order: tuple[str, ...] = PAGE_ORDER) -> None:
    """Write ``rows`` by ``order`` below ``path``, with the directory of the parts.

    The counts are taken from what was written, so a task that ran twice changes nothing. ``order``
    should leave no ties: rows that share it all stand in one part.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    (ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows"))
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")  # also an empty listing has columns
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())]))
    counts = written.parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n")).collect()
    before, entries = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in counts):  # as many rows as there are parts
        entries.append((part, n, before))
        before += n
    spark.createDataFrame(entries, _DIRECTORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, page: int, size: int,
              order: tuple[str, ...] = PAGE_ORDER) -> DataFrame:
    """Page ``page`` (from 1); a page behind the end has no rows."""
    first, end = (page - 1) * size, page * size
    directory = spark.read.schema(_DIRECTORY).parquet(f"{path}/directory")
    held = sorted((r["part"], r["before"]) for r in directory.where(
        (F.col("before") < end) & (F.col("before") + F.col("n") > first)).collect())
    none = spark.read.parquet(f"{path}/layout")
    if not held:
        return none
    rows = spark.read.schema(none.schema).parquet(*(f"{path}/rows/part={p}" for p, _ in held))
    return rows.orderBy(*order).offset(first - held[0][1]).limit(size)
