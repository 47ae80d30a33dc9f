"""A quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good, one from texts labelled bad. A
text is cut into chunks, each chunk is compressed with either dictionary by itself (so that a
dictionary counts as much late in a long text as at its start), and the difference of the summed sizes
over their sum says which of the two the text resembles. A logistic curve, fitted on labelled texts that
are in neither dictionary, turns that difference into a probability.

Only the fit reads labels, on a bounded sample: ``sample_rows`` labelled texts at most, half of either
class, drawn by a hash of ``doc_id``; ``sample_chunks`` chunks of each, spread over the text. A class
that is cut weighs in the curve as its share of all labels. Scoring reads whole texts.

Defined cases: a null text is empty; an empty text has the difference 0, so the curve's value there;
a sample without texts of both classes gives the share of good labels (0.5 without labels) as every
score; labels with a null id or quality are ignored, a label that occurs more than once counts once, as
good only if all say so; rows with an equal ``doc_id`` share their label and give the fit the least text;
a column named ``score`` or ``predicted`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.common import slices, texts


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8192
    sample_chunks: int = 16
    chunk: int = 1024
    dictionary: int = 112_640
    level: int = 1
    threshold: float = 0.3


def chunks(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def spread(parts: list[bytes], most: int) -> list[bytes]:
    """At most so many of the parts, from all over the text."""
    if len(parts) <= most:
        return parts
    return [parts[i * len(parts) // most] for i in range(most)]


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text (None: too few texts for one), and the curve's slope and
    intercept over the difference."""
    dictionaries: tuple[bytes, bytes] | None
    slope: float
    intercept: float


class Sizes:
    """The normalised difference of compressed sizes; positive if the good dictionary does better."""

    def __init__(self, dictionaries: tuple[bytes, bytes], settings: Settings) -> None:
        self._size, self._compress = settings.chunk, []
        for data in dictionaries:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=settings.level)
            self._compress.append(zstandard.ZstdCompressor(
                level=settings.level, dict_data=known, write_content_size=False, write_checksum=False,
                write_dict_id=False).compress)

    def of(self, parts: list[bytes]) -> float:
        bad, good = (sum(len(compress(part)) for part in parts) for compress in self._compress)
        return (bad - good) / (bad + good) if bad + good else 0.0

    def __call__(self, text: bytes) -> float:
        return self.of(chunks(text, self._size))


def build_dictionary(parts: list[bytes], size: int) -> bytes | None:
    """A dictionary of at most ``size`` bytes; None if there is too little to build one from."""
    size = min(size, sum(map(len, parts)) // 8)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if size >= 256 and len(parts) >= 8 else None
    except zstandard.ZstdError:
        return None


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps on the weighted likelihood; a small
    penalty on the slope (in units of the spread of ``x``) keeps it finite where classes part cleanly."""
    scale = x.std() or 1.0
    at = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight, w, ridge = weight / weight.mean(), np.zeros(2), np.array([1.0, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ w, -30, 30)))
        gradient = at.T @ (weight * (p - y)) + ridge * w
        curve = (at * (weight * p * (1 - p) + 1e-9)[:, None]).T @ at + np.diag(ridge)
        move = np.linalg.solve(curve, gradient)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``labels`` (``doc_id``, ``quality``: 1 good, 0 bad) and their texts."""
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality")).withColumn("order", F.xxhash64("doc_id")))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model(None, 0.0, 0.0)
    half = settings.sample_rows // 2
    drawn = [known.where(f"quality = {q}").orderBy("order", "doc_id").limit(half) for q in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # sample_rows rows of three numbers at most
    picked = (docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "quality", "order")
              .agg(F.min("text").alias("text")))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            parts = [spread(chunks(t, settings.chunk), settings.sample_chunks) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("quality"), pa.array(parts, pa.list_(pa.binary()))],
                ["order", "quality", "parts"])

    # sample_rows x sample_chunks x chunk bytes at most
    rows = picked.select("order", "quality", "text").mapInArrow(
        cut_up, "order bigint, quality int, parts array<binary>").collect()
    rows.sort(key=lambda r: (r["order"], r["quality"]))
    rows = [(r["quality"], [bytes(p) for p in r["parts"]]) for r in rows]
    # every other text of a class goes into its dictionary, the others fit the curve
    by_class = [[parts for q, parts in rows if q == c] for c in (0, 1)]
    good = totals.get(1, 0) / sum(totals.values())
    built = [build_dictionary([p for parts in own[::2] for p in parts if p], settings.dictionary) for own in by_class]
    if built[0] is None or built[1] is None or not by_class[0][1::2] or not by_class[1][1::2]:
        return Model(None, 0.0, float(np.log(max(good, 1e-6) / max(1 - good, 1e-6))))
    sizes = Sizes((built[0], built[1]), settings)
    x, y, weight = [], [], []
    for c, own in enumerate(by_class):
        rest = own[1::2]
        x += [sizes.of(parts) for parts in rest]
        y += [c] * len(rest)
        weight += [totals[c] / len(rest)] * len(rest)
    return Model((built[0], built[1]), *fit_curve(np.array(x), np.array(y, float), np.array(weight)))


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The columns of ``docs`` with ``score``, the probability of good quality, and ``predicted``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of settings.dictionary bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        sizes = Sizes(found.dictionaries, settings) if found.dictionaries else lambda text: 0.0
        for batch in slices(batches, "text"):
            x = np.fromiter(map(sizes, texts(batch)), float, batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(found.slope * x + found.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= settings.threshold).astype(np.int32))],
                [*kept, "score", "predicted"])

    fields = [docs.schema[c] for c in kept]
    return docs.select(*kept).mapInArrow(run, T.StructType(
        [*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
