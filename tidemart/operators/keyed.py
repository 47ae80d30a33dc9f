"""First or last row per key.

``row_number() = 1`` is planned as a group limit on both sides of the shuffle:
each map task keeps one row per key, so a key that holds a third of the input
costs one row per task, and no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(rows: DataFrame) -> Column:
    """A hash of the whole row, to order rows that are equal in all else."""
    return F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])


def _pick(rows: DataFrame, keys: Sequence[str], order: Sequence[Column],
          total: bool) -> DataFrame:
    ties = [] if total else [row_hash(rows)]
    ranked = Window.partitionBy(*keys).orderBy(*order, *ties)
    return (rows.withColumn("_rank", F.row_number().over(ranked))
            .where(F.col("_rank") == 1).drop("_rank"))


def first_per_key(rows: DataFrame, keys: Sequence[str], *order: str,
                  total: bool = False) -> DataFrame:
    """The first row per key by ``order``.

    Ties go by the hash of the whole row, so the result is the same on every
    run. ``total`` says that ``order`` leaves no ties: then no column is read
    for the hash, and those nobody asks for are not read at all.
    """
    return _pick(rows, keys, [F.col(c).asc_nulls_last() for c in order], total)


def last_per_key(rows: DataFrame, keys: Sequence[str], *order: str,
                 total: bool = False) -> DataFrame:
    """The last row per key by ``order``; otherwise as :func:`first_per_key`."""
    return _pick(rows, keys, [F.col(c).desc_nulls_last() for c in order], total)
