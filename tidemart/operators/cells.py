"""Facet cells: how many sales a day, level, gender and age class hold, kept by batches.

Each batch adds what its rows change: a sale that is new counts one in its cell, a sale that replaces
an earlier version takes one out of the cell of that version and puts one into its own. The facets
and the total of any days and level are sums of cells; the sales are not read for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.operators.keyed import last_per_key  # noqa: F401 (asked for by this name)
from tidemart.operators.search import age_class, gender_class
from tidemart.sinks import tables

CELL = ("dt", "user_level", "gender", "age")
CELLS = T.StructType([*(T.StructField(n, T.StringType()) for n in CELL), T.StructField("n", T.LongType())])
KEY = ("order_detail_id", "dt")
_ORDER = ("joined_rt", "batch", tables.ROW_HASH)
_CLASS = ("user_level", "gender", "age")
_DEALT = ("dt", "order_detail_id")


def changes(fresh: DataFrame, held: DataFrame, batch: int) -> DataFrame:
    """What ``fresh`` sale versions of one batch change about the cells of ``held`` versions.

    Every key of the batch counts one in the cell of its last version there. A key that was held before
    counts twice then, so the earlier one of its two last versions is taken out. Both sides are shuffled
    once and together, as cells, not as rows. They are dealt by ranges of day and key, so that a task has
    few days and counts few cells, and that a single day is dealt to many tasks.
    """
    return changes_of(newest(fresh, batch), held)


def newest(fresh: DataFrame, batch: int) -> DataFrame:
    """The versions of one batch, for :func:`changes_of`, which takes the last one per key."""
    return _versions(fresh.withColumn("batch", F.lit(int(batch)).cast("bigint")))


def changes_of(new: DataFrame, held: DataFrame) -> DataFrame:
    """:func:`changes` from the :func:`newest` versions."""
    both = new.withColumn("fresh", F.lit(True)).unionByName(_versions(held).withColumn("fresh", F.lit(False)))
    version = F.struct(*_ORDER, *_CLASS)
    last = (both.repartitionByRange(*_DEALT).groupBy(*_DEALT)
            .agg(F.max(F.when(F.col("fresh"), version)).alias("now"), F.max(F.when(~F.col("fresh"), version)).alias("was"))
            .where(F.col("now").isNotNull()))
    out = F.when(F.col("was").isNotNull(), F.least("was", "now"))
    signed = last.select("dt", F.inline(F.array(F.struct(F.col("now").alias("version"), F.lit(1).alias("n")),
                                                F.struct(out.alias("version"), F.lit(-1).alias("n")))))
    cell = [F.col(f"version.{c}") for c in _CLASS]
    return (signed.where(F.col("version").isNotNull()).groupBy("dt", *cell)
            .agg(F.sum("n").cast("bigint").alias("n")).where("n <> 0"))


def _versions(sales: DataFrame) -> DataFrame:
    """The key of a version, its place in the order of versions, nulls first, and what its cell is told by."""
    return sales.select(*KEY, *_ORDER, "user_level", gender_class().alias("gender"), age_class().alias("age"))


def total_of(cells: DataFrame, level: str | None = None) -> DataFrame:
    """The cells of a level, or of all, with what batches added and took out summed up."""
    if level:
        cells = cells.where(F.col("user_level") == level)
    return cells.groupBy("gender", "age").agg(F.sum("n").alias("n")).where("n <> 0")
