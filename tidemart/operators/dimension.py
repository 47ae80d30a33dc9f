"""The user dimension: latest values per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.operators.keyed import last_per_key


def latest_users(changes: DataFrame, *order: str) -> DataFrame:
    """Last version of each user id; an insert and an update both overwrite."""
    return last_per_key(changes.where(F.col("id").isNotNull()), ["id"],
                        *(order or ("change_ts",)))
