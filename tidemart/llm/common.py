"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.session import new_folder

#: Words are runs of anything but these six characters; ``bytes.split()`` cuts at exactly them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_HASHES_KEPT, _LONGEST_KEPT = 100_000, 64

#: What the operator at work keeps in this worker from task to task.
_kept: dict[Hashable, object] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers where they can't find it by themselves (the driver
    was started elsewhere and no path names it)."""
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in (Path.cwd().resolve(), *paths) or app in _shipped:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="tidemart-")) / "tidemart.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "tidemart").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps start from
    files that outlive any executor, and nothing upstream runs twice."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def own_table[T](owner: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept in this worker until another owner asks: workers serve one operator after
    the other, and the tables of all of them would add up."""
    if owner not in _kept:
        _kept.clear()
        give_back()
        _kept[owner] = make()
    return _kept[owner]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on without work while the JVM sorts and joins."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # no glibc
        pass


class _Hashes(dict):
    """Word to 64-bit hash; keeps short words only and forgets everything when full, so memory is
    bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > _LONGEST_KEPT:
            return xxhash.xxh64_intdigest(word)
        if len(self) >= _HASHES_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(own_table("word hashes", _Hashes).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the sequence that reads ``left`` then ``right``; the order matters."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(32))))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words: doubling, then one overlap."""
    have = 1
    while have < length:
        step = min(have, length - have)
        if len(hashes) <= step:
            return hashes[:0]
        hashes = join_hashes(hashes[:-step], hashes[step:])
        have += step
    return hashes


def packed(docs: DataFrame) -> DataFrame:
    """``text`` and the other columns as one struct, so that no name of theirs can clash."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row"), "text")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000
           ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes at once; a longer
    single text comes alone. After the last one, freed memory goes back."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
