"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as sequences of words (letters and digits, lower case), so line
breaks, case and punctuation do not matter. An item of m words may differ from a passage by an
error budget of ``ERRORS`` of its words: insertions, deletions and substitutions.

* *Pieces.* Each item is split into budget plus one pieces. A passage within the budget leaves at
  least one piece intact, so it holds that piece exactly.
* *Hits.* Runs of words of the texts are looked up among the pieces by hash.
* *Verification.* Around each hit the least edit distance between the whole item and any passage
  is computed with Myers' bit-parallel algorithm (one bit per word of the item, all texts' words
  around the hit in one pass). Only passages within the budget count.

The items are the stated query set: they are taken in blocks of bounded size, and each block is
sent to all tasks and met with all texts whole. Any number of items works: the texts are read
once per block, the driver and every worker hold one block at a time, and what a block found is
written before the next one is sent.

Defined cases: null and empty texts match nothing; items without words are ignored; items of few
words have a budget of zero and must occur exactly; repeated rows are judged alike; texts and
items of any length are taken whole; other columns are ignored (``decontaminate`` keeps them).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemart.llm.common import packed, slices, texts, unpacked, window_hashes, word_hashes
from tidemart.session import new_folder

#: Part of an item's words that may differ.
ERRORS = 0.15
#: Bytes of item texts in one block.
BLOCK_BYTES = 4 << 20
_WORDS = re.compile(r"[^\W_]+")
_NOT_PLAIN = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case runs of letters and digits."""
    if text.isascii():
        return text.translate(_NOT_PLAIN).lower().split()
    return [w.encode() for w in _WORDS.findall(text.decode().lower())]


def budget(n_words: int, errors: float = ERRORS) -> int:
    return int(n_words * errors)


def myers(item: list[int], passage: list[int]) -> tuple[int, int]:
    """(least edit distance of ``item`` to any part of ``passage``, end of the first best part)."""
    m = len(item)
    peq: defaultdict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        peq[word] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, word in enumerate(passage):
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a part may start anywhere: no cost before it
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Pieces:
    """The pieces of a block of items, by length and hash."""

    def __init__(self, items: list[tuple[int, bytes]], errors: float = ERRORS) -> None:
        self.items: list[tuple[int, list[int], int]] = []
        tables: defaultdict[int, defaultdict[int, list[tuple[int, int]]]] = defaultdict(
            lambda: defaultdict(list))
        for item_id, text in items:
            hashes = word_hashes(words_of(text))
            m = len(hashes)
            if not m:
                continue
            k = budget(m, errors)
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    tables[b - a][int(window_hashes(hashes[a:b], b - a)[0])].append((len(self.items), a))
            self.items.append((item_id, hashes.tolist(), k))
        self.tables = {}
        for n, table in tables.items():
            low = np.zeros(1 << 16, bool)  # a cheap look before the table itself
            low[np.fromiter(table, np.uint64, len(table)) & np.uint64(0xFFFF)] = True
            self.tables[n] = (low, dict(table))

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the best passage of every item within its budget."""
        around: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (low, table) in self.tables.items():
            runs = window_hashes(hashes, n)
            for at in np.flatnonzero(low[runs & np.uint64(0xFFFF)]).tolist():
                for item, offset in table.get(int(runs[at]), ()):
                    _, words, k = self.items[item]
                    around[item].append((max(0, at - offset - k), at - offset + len(words) + k))
        out = []
        for item, spans in around.items():
            item_id, words, k = self.items[item]
            best = (k + 1, 0)
            spans.sort()
            begin, end = spans[0]
            for a, b in [*spans[1:], (1 << 62, 0)]:
                if a <= end and a < 1 << 62:
                    end = max(end, b)
                    continue
                distance, at = myers(words, hashes[begin:end].tolist())
                best = min(best, (distance, begin + at))
                begin, end = a, b
            if best[0] <= k:
                out.append((item_id, *best))
        return sorted(out)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of about ``most`` bytes; the driver holds one block at a time."""
    block, held = [], 0
    rows = items.select("item_id", "text").where("text IS NOT NULL").dropDuplicates(["item_id", "text"])
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"].encode()))
        held += len(row["text"]) + 64
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


_FOUND = ArrayType(StructType().add("item_id", "long").add("distance", "integer")
                   .add("end_word", "integer"))


def _matched(docs: DataFrame, sent: Broadcast, errors: float) -> DataFrame:
    """``docs`` and the column ``found``: the matches with the items of one block."""
    ready: list[Pieces] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(Pieces(sent.value, errors))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()),
                                   ("end_word", pa.int32())]))
        for batch in slices(batches, "text"):
            found = [[{"item_id": i, "distance": d, "end_word": e}
                      for i, d, e in ready[0].matches(word_hashes(words_of(text)))]
                     for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, kind)], [*batch.schema.names, "found"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("found", _FOUND)]))


def _written(docs: DataFrame, blocks: Iterable[list[tuple[int, bytes]]], errors: float) -> DataFrame:
    """``digest`` of every text that holds a passage and ``found`` over all blocks. Each block is a
    job of its own that adds what it finds to one table, and goes before the next one is sent."""
    spark = docs.sparkSession
    keyed = docs.where("text IS NOT NULL").select(F.md5("text").alias("digest"), "text")
    folder = new_folder(spark, "benchmark-found")
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        hits = _matched(keyed, sent, errors).where(F.size("found") > 0).select("digest", "found")
        hits.dropDuplicates(["digest"]).write.mode("append").parquet(folder)
        sent.destroy()
    schema = StructType().add("digest", "string").add("found", _FOUND)
    return spark.read.schema(schema).parquet(folder).groupBy("digest").agg(
        F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def match_benchmark(docs: DataFrame, items: DataFrame, errors: float = ERRORS,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``docs`` and ``found``: the items within their budget in ascending order, each
    with its distance and the end of the passage in words. Items of one block are met in one pass
    over ``docs``; what several blocks find is written, and joined with ``docs`` by text."""
    kept = docs.drop("found")
    blocks = _blocks(items, block_bytes)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        return _matched(kept, kept.sparkSession.sparkContext.broadcast(block), errors)
    found = _written(kept, chain([block, more], blocks), errors)
    rows = kept.select(F.struct(*kept.columns).alias("row"), F.md5("text").alias("digest"))
    return rows.join(found, "digest", "left").select(
        *(F.col("row")[c].alias(c) for c in kept.columns),
        F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, errors: float = ERRORS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no passage of an item."""
    found = match_benchmark(packed(docs), items, errors, block_bytes)
    return unpacked(found.where(F.size("found") == 0), docs.columns)
