"""Near-duplicate classes with DartMinHash signatures and banded joining.

A text is the weighted set of its shingles of five words; the weight is how often one occurs.
Two texts are near duplicates if their weighted Jaccard similarity (sum of the lesser over sum of
the greater weights) is ``Settings.threshold`` or more; a class is a connected component of that
relation.

1. *Exact copies* fold into one text (by digest, combined on the map side).
2. *Signatures.* Hashed darts are thrown at the plane of weight and time over each shingle: a
   Poisson process that depends on the shingle alone, in layers of doubling weight. Darts below
   the shingle's weight count; each falls on one of ``coordinates``, and the earliest dart of a
   coordinate is its signature value. The time limit gives a text some ``coordinates`` x (ln
   ``coordinates`` + 3) darts however many shingles it has; where a coordinate stays empty the
   limit doubles. Equal values are as likely as the similarity says.
3. *Bands.* Texts with an equal band (``rows`` values) share a bucket. With 20 bands of 4, a pair
   at 0.8 meets with probability 1 - 3e-5.
4. *Links.* In each bucket, the member that shares the most buckets overall is compared with all
   others. Texts that share a bucket and are still in different classes are near duplicates only if they share one of
   their rarest shingles (:func:`_rare_members`, exact), so the buckets are dealt anew by these shingles: texts with
   many independent edits meet in small groups or not at all, though their bucket is large. Then a few members of
   a group's largest class, in each round others and more of them,
   are compared with the members outside it; what joins that class needs no further comparison.
   Groups with few members or few outside, and at last all, have each member outside compared with the members of
   other classes. So no two texts of a bucket stay in different classes unless they were compared or their rarest
   shingles show that they differ, and no bucket is
   expanded into all its pairs. A comparison first looks at four bits of each of the 80 signature
   values: with fewer than ``least_equal`` equal (a pair at 0.8 has 65 on average, and fewer than 40
   with probability 1e-10, far below what the bands lose), the two differ. All others are compared on all their shingles.
5. *Classes.* Least labels along links, by joins, until nothing changes.

Every step is a join or an aggregation; intermediate tables go to the shared folder.

Defined cases: a text of one to four words is one shingle; null texts and texts without words are
in a class of their own each, copies or not; the class is named by its least ``doc_id``; rows
with an equal ``doc_id`` are told apart by their text, and equal ones stay together in
``keep_one_each``, also with a null ``doc_id``, which is never a class's name unless no other is there:
then the text with the least digest stays; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.common import (
    cut, join_hashes, mix, packed, slices, texts, unpacked, window_hashes, word_hashes)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 4
    least_equal: int = 40
    speakers: tuple[int, ...] = (4, 16, 64)

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingles(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their numbers."""
    words = text.split()
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))) if words
                     else np.empty(0, np.uint64), return_counts=True)


def throw_darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray,
                coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of all elements up to the time limit of their owner: (owner and coordinate as one
    number, time, dart). A layer [2^v - 1, 2^(v+1) - 1) of the weight axis is a Poisson process of
    rate 2^v; its arrivals follow from hashes of the element, the layer and the count."""
    slots, times, darts = [], [], []
    layer = 0
    with np.errstate(over="ignore"):
        while True:
            low = 2.0 ** layer - 1
            at = np.flatnonzero(weights > low)
            if not len(at):
                break
            state = mix(elements[at] + np.uint64((layer + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = np.zeros(len(at))
            while len(at):
                state = mix(state + np.uint64(0xD1B54A32D192ED03))
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (low + 1)
                early = time <= limit[owner[at]]
                at, state, time = at[early], state[early], time[early]
                place = mix(state ^ np.uint64(0xA0761D6478BD642F))
                height = low + (low + 1) * ((place >> np.uint64(32)).astype(np.float64) * 2.0 ** -32)
                hit = height < weights[at]
                coordinate = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(coordinates)) >> np.uint64(32)
                slots.append(owner[at[hit]] * coordinates + coordinate[hit].astype(np.int64))
                times.append(time[hit])
                darts.append(state[hit])
            layer += 1
    return np.concatenate(slots), np.concatenate(times), np.concatenate(darts)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int,
               coordinates: int) -> np.ndarray:
    """One row of dart hashes per owner; every owner needs an element."""
    out = np.zeros((n, coordinates), np.uint64)
    total = np.bincount(owner, weights, n)
    limit = coordinates * (log(coordinates) + 3) / np.maximum(total, 1e-300)
    open_ = np.arange(n)
    while len(open_):
        number = np.full(n, -1)
        number[open_] = np.arange(len(open_))
        mine = number[owner] >= 0
        slot, time, dart = throw_darts(elements[mine], weights[mine], number[owner[mine]],
                                       limit[open_], coordinates)
        order = np.lexsort((time, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        slot, dart = slot[first], dart[first]
        found = np.zeros(len(open_) * coordinates, np.uint64)
        found[slot] = dart
        filled = np.bincount(slot // coordinates, minlength=len(open_)) == coordinates
        out[open_[filled]] = found.reshape(-1, coordinates)[filled]
        open_ = open_[~filled]
        limit[open_] *= 2
    return out


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    parts = signature.reshape(len(signature), settings.bands, settings.rows)
    keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), parts.shape[:2])
    for r in range(settings.rows):
        keys = join_hashes(keys, parts[:, :, r])
    return keys


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each value, sixteen values a number; the last number is filled with zeros."""
    nibbles = signature >> np.uint64(60)
    short = -nibbles.shape[1] % 16
    nibbles = np.pad(nibbles, ((0, 0), (0, short))).reshape(len(signature), -1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def _unequal(a: str, b: str, n: int) -> Column:
    """How many of the four-bit values differ."""
    total = F.lit(0)
    for i in range(n):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (1, 2):  # a value's lowest bit becomes the union of its four
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _bands(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sets = [shingles(t, settings.shingle) for t in texts(batch)]
            some = [i for i, (e, _) in enumerate(sets) if len(e)]
            if not some:
                continue
            sizes = [len(sets[i][0]) for i in some]
            signature = signatures(
                np.concatenate([sets[i][0] for i in some]),
                np.concatenate([sets[i][1] for i in some]).astype(np.float64),
                np.repeat(np.arange(len(some)), sizes), len(some), settings.coordinates)
            keys = band_keys(signature, settings).view(np.int64)
            bits = sketch(signature).view(np.int64)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * settings.bands
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(some)),
                 batch.column("digest").take(pa.array(some)),
                 pa.array([int(sets[i][1].sum()) for i in some], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                 pa.array(bits.tolist(), pa.list_(pa.int64()))],
                ["doc_id", "digest", "size", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, digest string, size bigint, bands array<bigint>, "
                                "sketch array<bigint>")


def _elements(docs: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and its shingles as sorted 32-bit hashes; the n-th repeat of one is its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in texts(batch):
                element, count = shingles(text, settings.shingle)
                repeat = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                hashes = mix(np.repeat(element, count) + repeat.astype(np.uint64))
                out.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(out, pa.binary())], ["node", "elements"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, elements binary")


def _similar(pairs: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            near = []
            for x, y in zip(texts(batch, "x"), texts(batch, "y"), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= settings.threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined = (pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
              .join(elements.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b"))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to. Labels move along links and then to the
    label of the label, so long chains shorten by half each time."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                               F.col("a").alias("b"))), "near-links")
    labels = cut(nodes.select("node", F.col("node").alias("label")), "near-labels")
    while True:
        met = (both.join(labels, both["b"] == labels["node"]).groupBy("a")
               .agg(F.min("label").alias("seen")))
        moved = (labels.join(met, labels["node"] == met["a"], "left")
                 .select("node", "label", F.least("label", "seen").alias("new")))
        up = moved.select(F.col("node").alias("via"), F.col("new").alias("further"))
        after = cut(moved.join(up, F.col("new") == F.col("via"), "left").select(
            "node", F.least("new", "further").alias("label"),
            (F.least("new", "further") < F.col("label")).alias("changed")), "near-labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only classes that a new link joins are labelled anew."""
    def of(end: str) -> DataFrame:
        return labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))

    between = cut(links.join(of("a"), "a").join(of("b"), "b").select(
        F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct(), "near-links")
    ends = between.select(F.col("a").alias("node")).union(between.select("b")).distinct()
    moved = connected(ends, between).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return cut(labels.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label")),
               "near-labels")


def _least_common(n: Column, m: Column, settings: Settings) -> Column:
    """Shingles that texts of ``n`` and ``m`` shingles have in common if they are near duplicates."""
    return F.ceil((n + m) * (settings.threshold / (1 + settings.threshold)) - 1e-6)


def _rare_members(there: DataFrame, nodes: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """Members of the buckets that two classes (``now``) share, dealt anew by shingle: ``key`` is a shingle that ``node`` holds among its
    rarest ones, ``at`` its place among them and ``n`` their number. Two near duplicates of n and m shingles
    share c = :func:`_least_common` of them, so the first n - c + 1 of one and the first m - c + 1 of the
    other, both from the rarest on, have one in common. Shingles of one text only take places, but no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "elements", 1_000_000):
            sets = [np.frombuffer(x, "<u4") for x in texts(batch, "elements")]
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(np.concatenate(sets).astype(np.int64))], ["node", "key"])

    sizes = elements.select("node", F.expr("length(elements) div 4").alias("n"))
    sized = there.select("key", "node", "now").join(sizes, "node")
    least = sized.groupBy("key").agg(F.min("n").alias("least"), F.min("now").alias("x"), F.max("now").alias("y")
                                     ).where("x < y")
    open_ = cut(sized.join(least, "key").groupBy("node").agg(
        F.first("n").alias("n"), F.greatest(F.min("least"), F.first("n") * settings.threshold).alias("least")), "near-open")
    held = cut(elements.join(open_, "node", "left_semi").mapInArrow(run, "node bigint, key bigint"), "near-shingles")
    shared = held.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    mine = Window.partitionBy("node")
    placed = (held.join(shared, "key").join(open_, "node")
              .withColumn("at", F.col("n") - F.count("*").over(mine)
                          + F.row_number().over(mine.orderBy("texts", "key"))))
    first = placed.where(F.col("at") <= F.col("n") - _least_common(F.col("n"), F.col("least"), settings) + 1)
    return cut(first.select("key", "node", "n", "at").join(nodes.select("node", "size", "sketch", "bands"), "node"),
               "near-rare")


def _candidates(there: DataFrame, centers: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): every center with the members of other classes beside it that it may resemble."""
    here = centers.select("key", F.col("node").alias("center"), *(
        F.col(c).alias(f"its_{c}") for c in there.columns if c not in ("key", "node")))
    fits = F.least("size", "its_size") >= settings.threshold * F.greatest("size", "its_size")
    close = _unequal("sketch", "its_sketch", -(-settings.coordinates // 16)) <= (
        settings.coordinates - settings.least_equal)
    if "at" in there.columns:
        common = _least_common(F.col("n"), F.col("its_n"), settings)
        fits &= (F.col("at") <= F.col("n") - common + 1) & (F.col("its_at") <= F.col("its_n") - common + 1)
        close &= F.arrays_overlap("bands", "its_bands")
    return (here.join(there, "key").where((F.col("its_label") != F.col("label")) & fits & close)
            .select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
            .distinct())


def near_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``class_id`` and ``stays`` (in :func:`keep_one_each`), one row
    per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.md5(text).alias("digest"), text.alias("text"))
    sketched = cut(_bands(keyed, settings), "near-bands")
    folded = sketched.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"))
    nodes = cut(folded.select(F.xxhash64("digest").alias("node"), "digest", "first", "size", "bands",
                              "sketch"), "near-nodes")

    each = nodes.select("node", F.explode("bands").alias("key"))
    crowded = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = each.join(crowded, "key")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    facts = nodes.select("node", "size", "sketch").join(degree, "node")
    members = cut(members.select("key", "node").join(facts, "node"), "near-members")
    inside = nodes.join(degree, "node", "left_semi").select("node", "digest", "first")
    elements = cut(_elements(
        keyed.join(inside.withColumnRenamed("digest", "of"), F.col("doc_id").eqNullSafe(F.col("first"))
                   & (F.col("digest") == F.col("of"))).select("node", "text").dropDuplicates(["node"]), settings), "near-elements")

    labels = cut(inside.select("node", F.col("node").alias("label")), "near-labels")
    turns = len(settings.speakers) + 2
    for turn in range(turns):
        there = members.join(labels, "node")
        split = there.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
        there = cut(there.join(split.select("key"), "key", "left_semi"), "near-split")
        if there.isEmpty():
            break
        if turn == 0:
            best = there.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("best"))
            centers = there.join(best, "key").where("node = best.node")
        else:
            counts = there.groupBy("key", "label").agg(F.count("*").alias("n_texts"))
            largest = counts.groupBy("key").agg(F.max(F.struct("n_texts", "label")).alias("most"),
                                                F.sum("n_texts").alias("total"))
            known = there.join(largest, "key")
            few = settings.speakers[min(turn, turns - 2) - 1]
            # as few outside, or as few in all, as would speak: at once, for no more pairs than that
            whole = (F.lit(turn == turns - 1) | (F.col("total") - F.col("most.n_texts") <= few)
                     | (F.col("total") <= settings.speakers[-1]))
            draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("most.n_texts"))
            centers = known.where(F.when(whole, F.col("label") != F.col("most.label")).otherwise(
                (F.col("label") == F.col("most.label")) & (draw < few)))
            members = known.where(~whole).select(members.columns)
        new = cut(_similar(_candidates(there, centers.select(there.columns), settings), elements, settings),
                  "near-links")
        if not new.isEmpty():
            labels = _merged(labels, new)
        if turn == 0:
            members = _rare_members(there.join(labels.select("node", F.col("label").alias("now")), "node"),
                                    nodes, elements, settings)

    class_of = (nodes.join(labels, "node", "left")
                .select("digest", "first", F.coalesce("label", "node").alias("label")))
    # the text that stays is that of the least id; where no member has one, that of the least digest
    named = class_of.groupBy("label").agg(
        F.min("first").alias("class_id"),
        F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "digest")).alias("keeper"))
    classes = class_of.join(named, "label").select("digest", "class_id", "keeper")
    rows = keyed.select("doc_id", "digest")
    return (rows.join(classes, "digest", "left").select(
        "doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.col("keeper").isNull() | F.col("doc_id").eqNullSafe(F.col("keeper.first"))
         & (F.col("digest") == F.col("keeper.digest"))).alias("stays")))


def keep_one_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that give their class its name, with all their columns."""
    gone = near_classes(docs, settings).where("NOT stays").select("doc_id", "digest").distinct()
    rows = packed(docs).select("*", F.col("_row.doc_id").alias("of"), F.md5(F.coalesce("text", F.lit(""))).alias("seen"))
    same = F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("seen") == F.col("digest"))
    return unpacked(rows.join(gone, same, "left_anti"), docs.columns)
