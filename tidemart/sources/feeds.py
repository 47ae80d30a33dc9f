"""Raw feeds and change events, as streams or as batches.

The format is a parameter: ``kafka`` where its package is on the class path,
else ``text``, ``json`` or ``parquet`` files. Whatever the format, a raw feed
is a DataFrame of ``value STRING`` and ``timestamp TIMESTAMP``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.functions.parse import good, parse_changes
from tidemart.schemas import CHANGE, FEEDS, RAW

_ROUTED = T.StructType([*RAW.fields, T.StructField("topic", T.StringType())])


def _as_raw(rows: DataFrame) -> DataFrame:
    arrival = (F.col("timestamp") if "timestamp" in rows.columns
               else F.current_timestamp().alias("timestamp"))
    return rows.select(F.col("value").cast("string").alias("value"), arrival)


def _options(fmt: str, feed: str | None, options: dict[str, str]) -> dict[str, str]:
    merged = {}
    if fmt == "kafka":
        merged["startingOffsets"] = "latest"
        if feed:
            merged["subscribe"] = FEEDS[feed].topic
    merged.update(options)
    return merged


def read_feed_stream(spark: SparkSession, feed: str | None, fmt: str, path: str | None = None,
                     **options: str) -> DataFrame:
    """One feed as a stream; ``feed`` None reads unrouted device logs.

    A Kafka source subscribes to the topic of the feed and starts at the
    latest offset; files below ``path`` are read in the order they appear.
    ``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` cap a micro-batch.
    """
    reader = spark.readStream.format(fmt).options(**_options(fmt, feed, options))
    if fmt in ("json", "parquet"):
        reader = reader.schema(RAW)
    return _as_raw(reader.load(path) if path else reader.load())


def read_feed(spark: SparkSession, feed: str | None, fmt: str, path: str | None = None,
              **options: str) -> DataFrame:
    """The same feed as a batch, for backfill."""
    merged = _options(fmt, feed, options)
    if merged.get("startingOffsets") == "latest":
        merged["startingOffsets"] = "earliest"
    reader = spark.read.format(fmt).options(**merged)
    if fmt in ("json", "parquet"):
        reader = reader.schema(RAW)
    return _as_raw(reader.load(path) if path else reader.load())


def read_topic_stream(spark: SparkSession, path: str, topic: str, **options: str) -> DataFrame:
    """One topic of the routed files below ``path`` (partitioned by topic).

    Only the folder of the topic is listed and read.
    """
    return _as_raw(spark.readStream.format("parquet").schema(RAW)
                   .options(recursiveFileLookup="true", **options)
                   .load(f"{path}/topic={topic}"))


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    return _as_raw(spark.read.schema(_ROUTED).parquet(path).where(F.col("topic") == topic))


def read_changes_stream(spark: SparkSession, path: str | None = None, fmt: str = "text",
                        max_files: int | None = None, **options: str) -> DataFrame:
    """Raw change events of all tables, one JSON object each; the router types them.

    For Kafka pass ``fmt="kafka"`` with ``subscribe``; ``maxOffsetsPerTrigger`` or ``max_files``
    cap a micro-batch.
    """
    if max_files:
        options["maxFilesPerTrigger"] = str(max_files)
    return read_feed_stream(spark, None, fmt, path, **options)


def read_changes(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """The same events as a batch, typed (:data:`tidemart.schemas.CHANGE`) where readable."""
    return good(parse_changes(read_feed(spark, None, fmt, path))).select(*CHANGE.fieldNames())
