"""Parquet tables written by batch id, and views of the last version per key.

A keyed upsert that rewrites its target costs as much as the table on every
micro-batch. These tables are written once per batch instead: each micro-batch
owns the folder ``run=<stream>/batch=<n>`` and replaces it whole, so a batch
that is repeated after a failure leaves the same files. The last version per
key is taken when a day is read.

A table by days has a commit log beside its files: once a batch is written
whole, an empty file ``_commits/period=<day>/<stream>.<n>`` is left for each
day that it holds. Readers list the log of the days they ask for and open the
folders it names; nothing else is listed, however long the history, and the
files of a batch that failed are never read. :func:`fold_days` replaces the
batches of a day by one sorted snapshot, which the log then names instead.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.operators.keyed import last_per_key, row_hash
from tidemart.session import brief_shuffles

BATCH_COLUMNS = ["run", "batch"]
ROW_HASH = "row_hash"
#: Leading characters of yyyy-MM-dd; a bucket is a number of three digits in place of a day.
PERIODS = {"day": 10, "month": 7, "bucket": 3}
#: Rows a task writes at least, where rows are not shuffled for it.
_FILE_ROWS = 100_000
#: So many periods at most are folded by a job each.
_FEW_PERIODS = 8
_BATCH_FIELDS = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns ``checkpoint``.

    It outlives restarts; a stream begun anew with an empty checkpoint gets
    another id and so cannot overwrite the batches of the old one.
    """
    line = spark.read.text(f"{checkpoint}/metadata").first()
    return json.loads(line[0])["id"]


def write_batch(rows: DataFrame, path: str, folder: str | None, run: str, batch: int,
                *sort: str) -> None:
    """Write one micro-batch, replacing what an earlier attempt of it left.

    ``rebalance`` lets AQE merge small and split large output partitions, so a
    batch that falls into one single folder is still written by many tasks.
    """
    folders = [folder] if folder else []
    placed = (rows.withColumns({"run": F.lit(run), "batch": F.lit(int(batch)).cast("bigint")})
              .hint("rebalance", *folders))
    if sort:
        placed = placed.sortWithinPartitions(*folders, *BATCH_COLUMNS, *sort)
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*folders, *BATCH_COLUMNS).parquet(path))


def _period(day: str, period: str):
    return F.substring(day, 1, PERIODS[period])


def write_days(rows: DataFrame, path: str, day: str, run: str, batch: int,
               period: str = "day", *sort: str, n_rows: int | None = None) -> None:
    """Write and commit one micro-batch of a table that is partitioned by the ``day`` column.

    The two steps are :func:`place_days` and :func:`commit_days`.
    """
    place_days(rows, path, day, run, batch, period, *sort, n_rows=n_rows)
    commit_days(rows.sparkSession, path, run, batch)


def place_days(rows: DataFrame, path: str, day: str, run: str, batch: int, period: str = "day", *sort: str,
               n_rows: int | None = None, as_made: bool = False) -> None:
    """Write the files of one micro-batch; nobody but :func:`read_batch` reads them before their commit.

    With ``period="month"`` a folder holds a month: for a table with few rows
    on each of very many days. The day stays a column either way; inside a
    month rows are sorted by it, so that row-group statistics still prune.
    Rows are shuffled together by period, unless their number is told: then they are written where they
    are, by as many tasks as they need: for rows of few periods. ``as_made`` leaves them to the tasks that
    make them, each of which writes a file a period: for wide rows right after a shuffle.
    """
    spark, own = rows.sparkSession, _own(path, run, batch)
    for name in _names(spark, own):  # an earlier attempt may have committed already
        _delete(spark, f"{path}/{_COMMITS}/{name}/{run}.{int(batch):012d}")
    placed = rows.withColumn("period", _period(day, period))
    if n_rows is not None:
        placed = placed.coalesce(1 + n_rows // _FILE_ROWS)
    elif not as_made:
        placed = placed.hint("rebalance", "period")
    keys = [*([] if period == "day" else [day]), *sort]
    if keys:
        placed = placed.sortWithinPartitions("period", *keys)
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("period").parquet(own))


def commit_days(spark: SparkSession, path: str, run: str, batch: int) -> None:
    """Let readers see what :func:`place_days` wrote."""
    for name in _periods_of(spark, _own(path, run, batch)):
        _touch(spark, f"{path}/{_COMMITS}/{name}/{run}.{int(batch):012d}")


def read_batch(spark: SparkSession, path: str, schema: T.StructType, run: str, batch: int) -> DataFrame:
    """The rows of one batch of a table by days, committed or not."""
    own = _own(path, run, batch)
    files = [f"{own}/{name}" for name in _periods_of(spark, own)]
    return spark.read.schema(schema).parquet(*files) if files else _no_rows(spark, schema)


def _own(path: str, run: str, batch: int) -> str:
    return f"{path}/run={run}/batch={int(batch)}"


def _periods_of(spark: SparkSession, own: str) -> list[str]:
    return [name for name in _names(spark, own) if name.startswith("period=")]


def _no_rows(spark: SparkSession, layout: T.StructType) -> DataFrame:
    """Rows that Spark knows to be none, so that joins with them are not run at all."""
    return spark.range(1).where(F.lit(False)).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in layout.fields))


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table without days, with their run and batch."""
    return _read(spark, path, path, T.StructType([*schema.fields, *_BATCH_FIELDS]))


def make_folder(spark: SparkSession, path: str) -> None:
    """Begin a table: from now on it has no rows, where an unknown path is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


# --- the commit log ----------------------------------------------------------------

_COMMITS = "_commits"


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    store, folder = _folder(spark, path)
    if not store.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(folder))


def _touch(spark: SparkSession, path: str) -> None:
    store, file = _folder(spark, path)
    store.create(file, True).close()


def _delete(spark: SparkSession, path: str) -> None:
    store, folder = _folder(spark, path)
    store.delete(folder, True)


@dataclass
class Held:
    """What the log of one period names: its newest snapshot, up to which batch of each stream that
    reaches, by which keys and order that holds last versions alone, and the later batches."""
    fold: int | None = None
    chosen: str = ""
    upto: dict[str, int] = field(default_factory=dict)
    batches: list[tuple[str, int]] = field(default_factory=list)


def committed(spark: SparkSession, path: str, periods: Iterable[str] | None = None) -> dict[str, Held]:
    """The log of the named periods, or of all."""
    root = f"{path}/{_COMMITS}"
    if periods is None:
        periods = [n.removeprefix("period=") for n in _names(spark, root)]
    out = {}
    for p in periods:
        held, folds, chosen, batches = Held(), {}, {}, []
        for name in _names(spark, f"{root}/period={p}"):
            kind, *rest = name.split(".")
            if kind != "fold":
                batches.append((kind, int(rest[0])))
            elif rest[1] == "done":
                held.fold = max(held.fold or 0, int(rest[0]))
                chosen[int(rest[0])] = "".join(rest[2:])
            else:
                folds.setdefault(int(rest[0]), {})[rest[1]] = int(rest[2])
        held.upto, held.chosen = folds.get(held.fold, {}), chosen.get(held.fold, "")
        held.batches = [(r, b) for r, b in batches if b > held.upto.get(r, -1)]
        if held.batches or held.fold is not None:
            out[p] = held
    return out


def open_periods(spark: SparkSession, path: str) -> list[str]:
    """Periods with batches that no snapshot holds."""
    return [p for p, held in committed(spark, path).items() if held.batches]


def last_mark(spark: SparkSession, path: str) -> str:
    """The greatest name that :func:`set_mark` left below ``path``, or an empty text."""
    return (_names(spark, path) or [""])[-1]


def set_mark(spark: SparkSession, path: str, name: str) -> None:
    """Leave a name; older ones that it exceeds go."""
    _touch(spark, f"{path}/{name}")
    for other in _names(spark, path):
        if other < name:
            _delete(spark, f"{path}/{other}")


def _check_period(spark: SparkSession, path: str, period: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    store, folder = _folder(spark, f"{path}/{_COMMITS}")
    entries = store.listStatusIterator(folder) if store.exists(folder) else None
    while entries and entries.hasNext():
        name = entries.next().getPath().getName()
        if name.startswith("period=") and "__HIVE" not in name:
            if len(name) != len("period=") + PERIODS[period]:
                raise ValueError(f"{path} is not partitioned by {period}: it has {name}")
            return


def read_days(spark: SparkSession, path: str, schema: T.StructType, day: str,
              days: Sequence[str] | None = None, period: str = "day") -> DataFrame:
    """Rows of a table written by :func:`write_days`, with their run and batch.

    With ``days`` only their folders are listed and read. A day without rows
    gives none; a path without a table, or one with other periods, is an error.
    """
    _check_period(spark, path, period)
    periods = None if days is None else sorted({d[:PERIODS[period]] for d in days})
    rows = _rows_of(spark, path, schema, committed(spark, path, periods))
    return rows if days is None else rows.where(F.col(day).isin(list(days)))


def _rows_of(spark: SparkSession, path: str, schema: T.StructType, held: dict[str, Held]) -> DataFrame:
    layout = T.StructType([*schema.fields, *_BATCH_FIELDS])
    files = [f"{path}/run={r}/batch={b}/period={p}" for p, h in held.items() for r, b in h.batches]
    folds = [_fold_path(path, p, h.fold) for p, h in held.items() if h.fold is not None]
    parts = []
    if files:
        placed = T.StructType([*layout.fields, T.StructField("period", T.StringType())])
        parts.append(spark.read.schema(placed).option("basePath", path).parquet(*files)
                     .select(*layout.fieldNames()))
    if folds:
        parts.append(spark.read.schema(layout).parquet(*folds))
    if not parts:
        return _no_rows(spark, layout)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _fold_path(path: str, period: str, number: int) -> str:
    return f"{path}_folded/fold={number:08d}/period={period}"


def fold_days(spark: SparkSession, path: str, schema: T.StructType, day: str, days: Sequence[str] | None = None,
              keys: Sequence[str] = (), order: Sequence[str] = (), period: str = "day") -> None:
    """Replace the batches of the named days, or of all, by one snapshot a period, sorted by day and key;
    with ``keys``, of the last version per key.

    Safe beside readers and a running stream: a snapshot counts once its last log entry is there,
    batches that are committed meanwhile are left for the next fold, and what a snapshot replaced is
    deleted by the fold after it, when no reader of the older log is at work any more. A batch that is
    repeated after it was folded changes nothing: the log names the snapshot for it. Without ``keys``, a
    few periods are folded one by one, without a shuffle; with them, the log tells by which, so that
    :func:`latest_days` need not choose again.
    """
    _check_period(spark, path, period)
    periods = None if days is None else sorted({d[:PERIODS[period]] for d in days})
    log = {p: held for p, held in committed(spark, path, periods).items() if held.batches}
    if not log:
        return
    number = 1 + max(-1 if held.fold is None else held.fold for held in log.values())
    with brief_shuffles(spark):
        if keys or len(log) > _FEW_PERIODS:
            _fold_together(_rows_of(spark, path, schema, log).withColumn("period", _period(day, period)), day, keys,
                           order, f"{path}_folded/fold={number:08d}")
        else:
            for p, held in log.items():
                rows = _rows_of(spark, path, schema, {p: held})
                (rows.coalesce(1 + rows.count() // _FILE_ROWS).sortWithinPartitions(day)
                 .write.mode("overwrite").parquet(_fold_path(path, p, number)))
    chosen = _choice(keys, order) if day in keys and ROW_HASH in schema.fieldNames() else ""
    for p, held in log.items():
        upto = dict(held.upto)
        for run, batch in held.batches:
            upto[run] = max(batch, upto.get(run, -1))
        entries = f"{path}/{_COMMITS}/period={p}/fold.{number:08d}"
        for run, batch in upto.items():
            _touch(spark, f"{entries}.{run}.{batch:012d}")
        _touch(spark, f"{entries}.done{chosen and '.'}{chosen}")
        _drop_folded(spark, path, p, held)


def _fold_together(rows: DataFrame, day: str, keys: Sequence[str], order: Sequence[str], target: str) -> None:
    sort = ["period", day, *(k for k in keys if k != day)]
    if keys:  # one shuffle and one sort serve the choice of versions and the files
        ties = [ROW_HASH] if ROW_HASH in rows.columns else []
        rows = last_per_key(rows.repartitionByRange(*sort), sort, *order, "batch", *ties, total=bool(ties))
    else:
        rows = rows.hint("rebalance", "period")
    (rows.sortWithinPartitions(*sort).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(target))


def _choice(keys: Sequence[str], order: Sequence[str]) -> str:
    """A name for the choice of the last version by these keys and this order."""
    return hashlib.sha256(json.dumps([sorted(keys), list(order)]).encode()).hexdigest()[:32]


def _drop_folded(spark: SparkSession, path: str, period: str, before: Held) -> None:
    """Delete what the snapshot ``before`` replaced."""
    if before.fold is None:
        return
    log = f"{path}/{_COMMITS}/period={period}"
    for name in _names(spark, log):
        kind, *rest = name.split(".")
        if kind == "fold" and int(rest[0]) < before.fold:
            _delete(spark, f"{log}/{name}")
            _delete(spark, _fold_path(path, period, int(rest[0])))
        elif kind != "fold" and int(rest[0]) <= before.upto.get(kind, -1):
            _delete(spark, f"{log}/{name}")
            own = f"{path}/run={kind}/batch={int(rest[0])}"
            _delete(spark, f"{own}/period={period}")
            if not any(n.startswith("period=") for n in _names(spark, own)):
                _delete(spark, own)


def read_table(spark: SparkSession, path: str, layout: T.StructType | str) -> DataFrame:
    """A plain table."""
    return _read(spark, path, path, layout)


def _read(spark: SparkSession, base: str, where: str,
          layout: T.StructType | str) -> DataFrame:
    return spark.read.schema(layout).option("basePath", base).parquet(where)


def days_of(rows: DataFrame, first, last=None) -> list[str]:
    """The different days of a column of times, or from the one to the other of each row: as many
    strings as a batch has days, however far apart they lie."""
    last = first if last is None else last
    each = F.explode(F.sequence(F.to_date(first), F.to_date(last)))
    found = rows.where(first.isNotNull() & last.isNotNull()).select(each.alias("day")).distinct()
    return sorted(r[0] for r in found.select(F.date_format("day", "yyyy-MM-dd")).collect())


def latest(table: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last version per key of rows written by :func:`versioned`.

    Later batches win among equals, then the stored hash decides; only the
    columns asked for and these are read.
    """
    return (last_per_key(table, keys, *order, "batch", ROW_HASH, total=True)
            .drop(*BATCH_COLUMNS, ROW_HASH))


def latest_days(spark: SparkSession, path: str, schema: T.StructType, day: str, keys: Sequence[str],
                order: Sequence[str], days: Sequence[str] | None = None, period: str = "day") -> DataFrame:
    """The last version per key of a table of :func:`write_days`; ``keys`` include the day.

    A period without batches since the fold that chose by just these keys and order is read as it is.
    """
    _check_period(spark, path, period)
    periods = None if days is None else sorted({d[:PERIODS[period]] for d in days})
    wanted = F.lit(True) if days is None else F.col(day).isin(list(days))
    choice, done, rest = _choice(keys, order), {}, {}
    for p, held in committed(spark, path, periods).items():
        (done if held.chosen == choice and not held.batches else rest)[p] = held
    rows = latest(_rows_of(spark, path, schema, rest).where(wanted), keys, *order)
    if not done:
        return rows
    folded = _rows_of(spark, path, schema, done).where(wanted).drop(*BATCH_COLUMNS, ROW_HASH)
    return rows.unionByName(folded) if rest else folded


def versioned(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order, with the hash of the row at its end."""
    names = [n for n in schema.fieldNames() if n != ROW_HASH]
    picked = rows.select(*names)
    return picked.withColumn(ROW_HASH, row_hash(picked))


def publish(spark: SparkSession, source: str, target: str, schema: T.StructType, day: str,
            keys: Sequence[str], order: Sequence[str], days: Sequence[str] | None = None,
            period: str = "day") -> None:
    """Rebuild day partitions of ``target`` with one row per key.

    Reads the batch table and never its own output, so it can be repeated at
    any time; days not named stay as they are. ``keys`` include the day.
    """
    rows = latest(read_days(spark, source, schema, day, days, period), keys, *order)
    (rows.withColumn("period", _period(day, "day")).hint("rebalance", "period")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period").parquet(target))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Finished snapshots of a folded table, oldest first."""
    store, folder = _folder(spark, f"{path}_folded")
    if not store.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in store.listStatus(folder))
    return [f"{path}_folded/{n}" for n in names if exists(spark, f"{path}_folded/{n}/upto/_SUCCESS")]


def _upto(spark: SparkSession, snapshot: str) -> dict[str, int]:
    """The last batch of each stream that a snapshot holds; one row per stream."""
    rows = spark.read.schema("run STRING, batch BIGINT").parquet(f"{snapshot}/upto").collect()
    return {r["run"]: r["batch"] for r in rows}


def _newer(upto: dict[str, int]):
    newer = ~F.col("run").isin(list(upto))
    for run, batch in upto.items():
        newer |= (F.col("run") == run) & (F.col("batch") > batch)
    return newer


def read_folded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Versions of a table of :func:`write_batch`: its newest snapshot, if :func:`fold` made one, and
    the batches since. What is read does not grow with the number of batches ever written."""
    snapshots = _snapshots(spark, path)
    rows = read_batches(spark, path, schema)
    if not snapshots:
        return rows
    layout = T.StructType([*schema.fields, *_BATCH_FIELDS])
    old = spark.read.schema(layout).parquet(f"{snapshots[-1]}/rows")
    return old.unionByName(rows.where(_newer(_upto(spark, snapshots[-1]))))


def fold(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], *order: str) -> None:
    """Write the last version per key as a new snapshot, and drop the batch folders that the
    snapshot before it had folded already: readers of that one do not open them either.

    A snapshot counts once its list of batches is complete, so a fold that fails changes nothing.
    Run it from one place, between batches or beside them.
    """
    before = _snapshots(spark, path)
    rows = read_folded(spark, path, schema)
    seen = read_batches(spark, path, schema).groupBy("run").agg(F.max("batch").alias("batch"))
    upto = (_upto(spark, before[-1]) if before else {}) | {r["run"]: r["batch"] for r in seen.collect()}
    if not upto:
        return
    held = rows.where(~_newer(upto))  # a batch that is written meanwhile is left for the next fold
    target = f"{path}_folded/{len(before):08d}"
    if before:
        target = f"{path}_folded/{int(before[-1].rpartition('/')[2]) + 1:08d}"
    kept = last_per_key(held, keys, *order, "batch", ROW_HASH, total=True)
    kept.hint("rebalance").write.mode("overwrite").parquet(f"{target}/rows")
    (spark.createDataFrame(list(upto.items()), "run STRING, batch BIGINT").coalesce(1)
     .write.mode("overwrite").parquet(f"{target}/upto"))
    for run, last in (_upto(spark, before[-1]) if before else {}).items():
        store, folder = _folder(spark, f"{path}/run={run}")
        for entry in store.listStatus(folder) if store.exists(folder) else []:
            name = entry.getPath().getName()
            if name.startswith("batch=") and int(name[len("batch="):]) <= last:
                store.delete(entry.getPath(), True)
    for snapshot in before[:-1]:
        store, folder = _folder(spark, snapshot)
        store.delete(folder, True)


def write_topics(rows: DataFrame, fmt: str, path: str | None = None, run: str = "batch",
                 batch: int = 0, **options: str) -> None:
    """Send (topic, value) rows to their topics.

    Kafka takes the topic from the column. As files, each topic is a folder
    and a repeated batch replaces its own files.
    """
    if fmt == "kafka":
        rows.select("topic", "value").write.format("kafka").options(**options).save()
        return
    write_batch(rows.select("topic", "value", "timestamp"), path, "topic", run, batch)


def archive(rows: DataFrame, path: str, run: str = "batch", batch: int = 0) -> None:
    """Keep raw records, stamped, one folder per day of arrival."""
    write_days(rows.select("value", F.date_format("timestamp", "yyyy-MM-dd").alias("day")),
               path, "day", run, batch)
