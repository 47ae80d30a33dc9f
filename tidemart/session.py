"""Session set-up and the shared scratch folder.

Nothing here names a machine: on a cluster the scratch folder is the one given
as ``spark.checkpoint.dir``; only a local master may fall back to a temporary
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# SQL settings every job relies on. Sizes follow the data at run time: AQE
# coalesces or splits shuffle partitions, turns a shuffled join into a
# broadcast one when the measured side is small, and splits skewed partitions.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the next step relies on the placing of the
    # join; Spark then shuffles partial results once more
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # feeds and columns unfold to a multiple of their files in a task that caches or sorts them
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.parquet.compression.codec": "zstd",
}

STREAM_DEFAULTS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: Shuffles begin with as many partitions at least, so that sorts fit into memory; AQE merges small ones.
FIRST_PARTITIONS = 400
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: dict[str, str] = {}


def build_session(app: str = "tidemart", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the defaults above.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` for the
    largest job (about 128-256 MB per partition); AQE merges what is too small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SQL_DEFAULTS, **STREAM_DEFAULTS,
                # no Python call-site capture per column expression
                "spark.python.sql.dataFrameDebugging.enabled": "false"}
    settings[_FIRST] = str(max(FIRST_PARTITIONS, shuffle_partitions or 0))
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in {**SQL_DEFAULTS, **STREAM_DEFAULTS}.items():
        spark.conf.set(key, value)
    spark.conf.set(_FIRST, str(max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


@contextmanager
def shuffle_partitions(spark: SparkSession, number: int) -> Iterator[None]:
    """Start a stream with its own number of partitions.

    A stateful stream keeps the number it was first started with as long as
    its checkpoint lives, and AQE does not merge its partitions: size it for
    the cluster, not for the largest batch job.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(number))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned inside go when it has run, not when the driver happens to collect
    its garbage. For writes, and for streams that are started inside: their sessions keep the setting.

    Rows that are run a second time from the same DataFrame are shuffled a second time.
    """
    before = spark.conf.get(_BRIEF, None)
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BRIEF)
        else:
            spark.conf.set(_BRIEF, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="tidemart-")
    return _local_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
