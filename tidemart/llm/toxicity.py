"""Toxicity by a classifier chain.

Categories are predicted one after the other. The model of a category is a linear (logistic) one
over words and word beginnings, and over the probabilities of the categories before it. For
training, those probabilities are out-of-fold: each labelled text gets them from models that did
not see it, so a later model learns how far an earlier one can be trusted. The last category is
the verdict.

The fit uses at most ``Settings.sample_rows`` labelled texts, half of them of the positive class
where there are as many, the least by a hash of the id: bounded whatever the table holds. Where
that cuts a class, its texts weigh as much as all labels of the class would, relative to the other
class, so that the probabilities are those of the labels and not of the halves.
The sample is written once and read from there. Features are counted in the tasks; the driver gets
``features`` names and, for each sampled text, the counts that are not zero. It fits in blocks of
``_ROWS_AT_ONCE`` texts, so that it holds one small number for each text and feature and no copies of
the whole. All texts are scored, whole, in the tasks.

Labels come as rows ``(doc_id, toxic)`` with any number of further label columns (0, 1 or null),
which are the earlier categories of the chain in the order of the columns: narrower kinds of toxicity
where there are labels for them, else whatever else a text was judged for, such as its quality. A text
without a label in an earlier category is left out of that category's models and gets its probability.

Defined cases: a null or empty text has no features and the verdict of the intercept; a null
label or id, and labels of unknown documents, are ignored; repeated rows are scored alike, and of
rows with an equal labelled id only the least text is learned from; if the
labels hold one class only, or none, everything gets that class's probability (0 without labels);
other columns are kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import cut, give_back, own_table, packed, slices, texts, unpacked
from tidemart.llm.decontamination import words_of

#: The last category of the chain.
VERDICT = "toxic"
_STEMS = (4, 5, 6)
_WORDS_KEPT = 200_000
_ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8192
    features: int = 512
    earlier_features: int = 64
    least_texts: int = 5
    folds: int = 4
    penalty: float = 0.05
    threshold: float = 0.4


def word_features(word: bytes) -> list[str]:
    text = word.decode()
    return [f"={text}", *(f"{text[:n]}*" for n in _STEMS if len(text) >= n)]


def text_features(text: bytes) -> set[str]:
    return {f for word in set(words_of(text)) for f in word_features(word)}


def categories_of(labels: DataFrame) -> list[str]:
    """The chain that a table of labels gives."""
    return [*(c for c in labels.columns if c not in ("doc_id", VERDICT)), VERDICT]


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic, marks, fold, share) of the bounded sample; ``marks`` are the labels in the order of
    the chain, -1 for none, and ``share`` is how many labels of its class there are for each one drawn."""
    marks = F.array(*(F.coalesce(F.max(F.col(c).cast("int")), F.lit(-1)) for c in categories_of(labels)))
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic"), marks.alias("marks"))
             .withColumn("order", F.xxhash64("doc_id")))
    half = settings.sample_rows // 2
    totals = {r["toxic"]: r["n"] for r in
              known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [known.where(f"toxic = {c}").orderBy("order", "doc_id").limit(half)
           .withColumn("share", F.lit(max(1.0, totals.get(c, 0) / max(half, 1)))) for c in (1, 0)]
    rows = F.broadcast(few[0].unionByName(few[1]))  # at most sample_rows rows of four numbers
    fold = F.pmod("order", F.lit(settings.folds)).cast("int").alias("fold")
    return (docs.select("doc_id", "text").join(rows, "doc_id")
            .groupBy("doc_id", "toxic", "marks", fold, "share").agg(F.min("text").alias("text"))
            .select("text", "toxic", "marks", "fold", "share"))


def _choose_features(sample: DataFrame, n: int, least_texts: int) -> list[str]:
    """The features that tell the classes ``toxic`` of the sample apart best (chi-squared over texts)."""
    most = n
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = (Counter(), Counter())
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(text_features(text))
            for toxic in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen[toxic]), pa.string()), pa.array([toxic] * len(seen[toxic]), pa.int32()),
                     pa.array(list(seen[toxic].values()), pa.int64())], ["feature", "toxic", "n"])

    totals = {r["toxic"]: r["n"] for r in
              sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    counts = (sample.select("text", "toxic").mapInArrow(count, "feature string, toxic int, n bigint")
              .groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("b"),
                                      F.sum(F.col("n") * (1 - F.col("toxic"))).alias("g"))
              .where(F.col("b") + F.col("g") >= least_texts))
    b, g, n = F.col("b"), F.col("g"), bad + good
    chi = (n * F.pow(b * (good - g) - g * (bad - b), F.lit(2))
           / ((b + g) * (n - b - g + 0.5) * bad * good))
    best = counts.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature")
    return [r["feature"] for r in best.limit(most).collect()]


class FeatureRows:
    """How often each chosen feature occurs in each text."""

    def __init__(self, features: list[str]) -> None:
        self._numbers = {f: i for i, f in enumerate(features)}
        self._words: dict[bytes, list[int]] = {}

    def rows(self, batch: list[bytes]) -> np.ndarray:
        out = np.zeros((len(batch), len(self._numbers)), np.float32)
        known = self._words
        for i, text in enumerate(batch):
            for word, n in Counter(words_of(text)).items():
                at = known.get(word)
                if at is None:
                    if len(known) > _WORDS_KEPT:
                        known.clear()
                    at = known[word] = [self._numbers[f] for f in word_features(word)
                                        if f in self._numbers]
                if at:
                    out[i, at] += n
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(rows), _ROWS_AT_ONCE):
        yield rows[i:i + _ROWS_AT_ONCE]


def fit_logistic(inputs: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, y: np.ndarray, penalty: float,
                 share: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights with the intercept last: penalized maximum likelihood by Newton steps, over ``rows``.
    ``inputs`` gives the features of some rows, ones last; ``share`` says for how many texts each row
    counts, relative to the others."""
    width, known = inputs(rows[:0]).shape[1], y[rows]
    if not len(rows) or known.min() == known.max():
        out = np.zeros(width)
        out[-1] = 30.0 if len(rows) and known[0] else -30.0
        return out
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-6
    mean = share[rows].mean()
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for at in _blocks(rows):
            x, each = inputs(at), share[at] / mean
            p = _sigmoid(x @ w)
            gradient += x.T @ (each * (p - y[at]))
            x *= np.sqrt(each * p * (1 - p) + 1e-9)[:, None]
            curve += x.T @ x
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, targets: list[np.ndarray], folds: np.ndarray, penalty: float,
              share: np.ndarray | None = None, columns: list[list[int]] | None = None,
              values: np.ndarray | None = None) -> list[np.ndarray]:
    """One weight vector per category, over its own ``columns`` of the features (all by default) and the
    earlier probabilities; a target below 0 is unknown. With ``values``, ``x`` holds places in them."""
    models, earlier = [], np.zeros((len(x), 0))
    columns = columns or [list(range(x.shape[1]))] * len(targets)
    share = np.ones(len(x)) if share is None else share
    for y, own in zip(targets, columns, strict=True):
        def inputs(rows: np.ndarray, own: list[int] = own, earlier: np.ndarray = earlier) -> np.ndarray:
            part = x[np.ix_(rows, np.array(own, int))]
            return np.hstack([part if values is None else values[part], earlier[rows], np.ones((len(rows), 1))])

        known = y >= 0
        out_of_fold = np.zeros(len(x))
        for fold in np.unique(folds):
            w = fit_logistic(inputs, np.flatnonzero((folds != fold) & known), y, penalty, share)
            for rows in _blocks(np.flatnonzero(folds == fold)):
                out_of_fold[rows] = _sigmoid(inputs(rows) @ w)
        models.append(fit_logistic(inputs, np.flatnonzero(known), y, penalty, share))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return models


def chain_probabilities(x: np.ndarray, models: list[np.ndarray],
                        columns: list[list[int]] | None = None) -> np.ndarray:
    probabilities = np.zeros((len(x), 0))
    columns = columns or [list(range(x.shape[1]))] * len(models)
    for w, own in zip(models, columns, strict=True):
        inputs = np.hstack([x[:, own], probabilities])
        probabilities = np.hstack([probabilities, _sigmoid(inputs @ w[:-1] + w[-1])[:, None]])
    return probabilities


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    features: list[str]
    models: list[np.ndarray]
    columns: list[list[int]]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Chain:
    categories = categories_of(labels)
    sample = cut(_sample(docs, labels, settings), "toxicity-sample")
    chosen = []
    for c, category in enumerate(categories):
        own = sample.select("text", F.col("marks")[c].alias("toxic")).where("toxic >= 0")
        n = settings.features if category == VERDICT else settings.earlier_features
        chosen.append(_choose_features(own, n, settings.least_texts))
    features = list(dict.fromkeys(f for names in chosen for f in names))
    columns = [[features.index(f) for f in names] for names in chosen]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = FeatureRows(features).rows
        for batch in slices(batches, "text"):
            counts = rows_of(texts(batch)).astype(np.uint32)
            places = [np.flatnonzero(c).astype(np.uint32) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes() for p in places], pa.binary()),
                 pa.array([c[p].tobytes() for c, p in zip(counts, places, strict=True)], pa.binary()),
                 *(batch.column(c) for c in ("marks", "fold", "share"))], ["places", "counts", "marks", "fold", "share"])

    found = sample.select("text", "marks", "fold", "share").mapInArrow(
        counted, "places binary, counts binary, marks array<int>, fold int, share double").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True))
    x, values = _places_in_values([r[:2] for r in rows], len(features))
    targets = [np.array([r[2][c] for r in rows], float) for c in range(len(categories))]
    folds = np.array([r[3] for r in rows], int)
    share = np.array([r[4] for r in rows])
    del found, rows
    models = fit_chain(x, targets, folds, settings.penalty, share, columns, np.log1p(values))
    del x
    give_back()
    return Chain(tuple(categories), features, models, columns)


def _places_in_values(rows: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (places, counts) as a matrix of the smallest numbers that can hold it, and the counts
    that they stand for."""
    values = np.unique(np.frombuffer(b"".join([np.uint32(0).tobytes(), *(counts for _, counts in rows)]), np.uint32))
    x = np.zeros((len(rows), width), np.min_scalar_type(len(values)))
    for row, (places, counts) in zip(x, rows, strict=True):
        row[np.frombuffer(places, np.uint32)] = np.searchsorted(values, np.frombuffer(counts, np.uint32))
    return x, values.astype(float)


def score(docs: DataFrame, chain: Chain, settings: Settings = Settings()) -> DataFrame:
    """Columns of ``docs``, ``p_<category>`` in the order of the chain, and ``toxic``."""
    names = [f"p_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in (*names, "toxic")]
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # some hundred numbers a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = sent.value.features
        rows_of = own_table(("features", *features), lambda: FeatureRows(features)).rows
        for batch in slices(batches, "text", 1_000_000):
            p = chain_probabilities(np.log1p(rows_of(texts(batch))), sent.value.models,
                                    sent.value.columns)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(x) for x in p.T),
                 pa.array(p[:, -1] >= settings.threshold)], [*kept, *names, "toxic"])

    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select(*kept).mapInArrow(run, schema.add("toxic", "boolean"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that the chain does not reject."""
    scored = score(packed(docs), train(docs, labels, settings), settings)
    return unpacked(scored.where(~F.col("toxic")), docs.columns)
