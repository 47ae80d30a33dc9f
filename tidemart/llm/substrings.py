"""Removal of passages that repeat across documents, with prefix-partitioned suffix trees.

A word is removed when it lies in a window of ``WINDOW`` consecutive words whose sequence also
starts in a document with a smaller id. The suffixes of all documents are never listed; four
steps narrow them down, each without loss:

1. *Anchors.* Of every ``WINDOW`` words at least one run of ``PREFIX`` words is an anchor (the
   run with the least hash among those that fit). Equal windows have equal anchors, so a window
   that repeats across documents holds an anchor that does. Anchors are a few per cent of all
   positions; a hash with its least and greatest document is enough to see which are shared.
2. *Suffixes.* Only starts whose window holds a shared anchor become suffix rows. A row carries
   hashes of its first 8, 16, 32 and 50 words: the path from the root to depth 50.
3. *Partition by prefix.* A group of suffixes is named by the shortest of these prefixes that at
   most ``GROUP`` suffixes have; longer prefixes split larger groups. What still exceeds
   ``GROUP`` at depth 50 is one node: nothing below it matters, so its least document comes from
   an aggregation with map-side combine. All other groups go to tasks in the order of their
   path, which visits the subtree depth first, and each inner node of depth 50 or more (a run of
   equal paths) gives the least document of its leaves. A maximal repeat is a chain of such
   nodes at consecutive starts; its words are what is removed.
4. *Removal.* Starts below a node with a smaller document come back to their document, and the
   words they cover go.

Exact copies are settled by a digest of the text before step 2, so groups of copies do not
multiply suffixes. Words are compared by 64-bit hashes, windows by 128 bits of the path.

Defined cases: null and empty texts have no words; texts shorter than the window lose nothing;
rows with an equal ``doc_id`` are one document for comparisons and each keeps its row; a row with
a null ``doc_id`` loses nothing and makes nobody else's words repeats; windows are judged
on the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import cut, slices, texts, window_hashes, word_hashes

WINDOW, PREFIX = 50, 8
#: Suffixes that one group of a subtree may have.
GROUP = 20_000
#: Prefixes that may be split further, at most.
MOST_CROWDED = 10_000
_FIT = WINDOW - PREFIX + 1  # runs of PREFIX words in a window
_DEPTHS = (8, 16, 32)  # prefixes that can name a group; the path ends at WINDOW


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """For every window of ``WINDOW`` words, its anchor: the least hash of the runs in it."""
    grams = window_hashes(hashes, PREFIX)
    n = len(grams) - _FIT + 1
    if n <= 0:
        return grams[:0]
    # blocks of _FIT: a window's least is that of a block's tail or of the next block's head
    padded = np.full(-(-len(grams) // _FIT) * _FIT, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(grams)] = grams
    blocks = padded.reshape(-1, _FIT)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[_FIT - 1:_FIT - 1 + n])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a digest of the text; (doc_id, tag) names a row in later steps."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.md5(text).alias("digest")).withColumn(
        "tag", F.conv(F.substring("digest", 1, 7), 16, 10).cast("int"))


def anchors(keyed: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``tag`` and the distinct anchors of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [_signed(np.unique(window_anchors(word_hashes(t.split())))) for t in texts(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("digest"), batch.column("tag"),
                 pa.ListArray.from_arrays(offsets, pa.array(values))],
                ["doc_id", "digest", "tag", "anchors"])

    return keyed.where("doc_id IS NOT NULL").mapInArrow(
        run, "doc_id bigint, digest string, tag int, anchors array<bigint>")


def suffixes(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """Suffix rows of the windows whose anchor is in ``shared`` (doc_id, tag, anchors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            for doc, tag, text, wanted in zip(
                    batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(),
                    texts(batch), batch.column("anchors").to_numpy(zero_copy_only=False), strict=True):
                hashes = word_hashes(text.split())
                starts = np.flatnonzero(np.isin(_signed(window_anchors(hashes)), wanted))
                path = [window_hashes(hashes, d)[starts] for d in (*_DEPTHS, WINDOW)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32)) for x in path[:-1]),
                     pa.array(_signed(path[-1])), pa.array(np.full(len(starts), doc, np.int64)),
                     pa.array(np.full(len(starts), tag, np.int32)), pa.array(starts.astype(np.int32))],
                    ["p8", "p16", "p32", "p50", "doc_id", "tag", "at"])

    joined = keyed.select("doc_id", "tag", "text").join(shared, ["doc_id", "tag"])
    return joined.mapInArrow(
        run, "p8 int, p16 int, p32 int, p50 bigint, doc_id bigint, tag int, at int")


def _crowded(rows: DataFrame, path: list[str], most: int) -> DataFrame:
    """Prefixes with more than ``most`` suffixes."""
    found = rows.groupBy(*path).count().where(F.col("count") > most).select(*path)
    return cut(found, "substring-crowded")


def _below(rows: DataFrame) -> DataFrame:
    """Starts under a node of depth WINDOW that a smaller document shares. Rows come grouped and
    in path order with the least document first, so a subtree is walked as it streams in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path = [batch.column(c).to_numpy() for c in ("p8", "p16", "p32", "p50")]
            docs = batch.column("doc_id").to_numpy()
            first = np.ones(len(docs), bool)
            first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in path])
            goes_on = node is not None and node == tuple(x[0] for x in path)
            first[0] = not goes_on
            heads = np.flatnonzero(first)
            owner = np.concatenate([[least], docs[heads]])[np.cumsum(first)]
            node, least = tuple(x[-1] for x in path), owner[-1]
            gone = pa.array(docs > owner)
            yield batch.select(["doc_id", "tag", "at"]).filter(gone)

    return rows.select("p8", "p16", "p32", "p50", "doc_id", "tag", "at").mapInArrow(
        run, "doc_id bigint, tag int, at int")


def repeated_starts(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``tag``, ``at`` of the suffixes that start in a smaller document as well."""
    # with at least a MOST_CROWDED-th of the suffixes each, there are no more crowded prefixes than
    # that at any depth: their lists, and the nodes of depth 50 below, are safe to broadcast
    most = max(group, rows.count() // MOST_CROWDED)
    paths = [["p8"], ["p8", "p16"], ["p8", "p16", "p32"], ["p8", "p16", "p32", "p50"]]
    grouped, crowd = [], rows
    for path in paths:
        crowded = _crowded(crowd, path, most)
        none = crowded.isEmpty()
        few = crowd if none else crowd.join(F.broadcast(crowded), path, "left_anti")
        grouped.append(few.withColumn("group", F.xxhash64(F.lit(len(path)), *path)))
        if none:
            break
        crowd = crowd.join(F.broadcast(crowded), path, "left_semi")
    suffixes_of = reduce(DataFrame.unionByName, grouped)
    walked = _below(suffixes_of.repartition("group").sortWithinPartitions(*paths[-1], "doc_id"))
    if none:
        return walked
    nodes = F.broadcast(crowd.groupBy(*paths[-1]).agg(F.min("doc_id").alias("least")))
    hot = crowd.join(nodes, paths[-1]).where("doc_id > least").select("doc_id", "tag", "at")
    return walked.unionByName(hot)


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by a
    space."""
    keyed = _keyed(docs)
    found = cut(anchors(keyed), "substring-anchors")
    texts_of = found.select("doc_id", "digest", "tag").distinct()
    first = texts_of.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = texts_of.join(first, "digest").where("doc_id > first")
    whole = copies.select("doc_id", "tag", F.array(F.lit(-1)).alias("at"))

    listed = (found.dropDuplicates(["doc_id", "digest"]).join(copies, ["doc_id", "digest"], "left_anti")
              .select("doc_id", "tag", F.explode("anchors").alias("anchor")))
    shared = (listed.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
              .where("a < b").select("anchor"))
    of_doc = (listed.join(shared, "anchor").groupBy("doc_id", "tag")
              .agg(F.collect_list("anchor").alias("anchors")))
    rows = cut(suffixes(keyed, of_doc), "substring-suffixes")
    gone = (repeated_starts(rows, group).groupBy("doc_id", "tag")
            .agg(F.collect_list("at").alias("at")).unionByName(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, at in zip(texts(batch), batch.column("at").to_numpy(zero_copy_only=False),
                                strict=True):
                words = text.split()
                n = len(words)
                if at is not None and n >= WINDOW:
                    change = np.zeros(n + 1, np.int64)
                    if at[0] < 0:
                        at = np.arange(n - WINDOW + 1)
                    change[at] = 1
                    change[np.asarray(at) + WINDOW] -= 1
                    stays = np.cumsum(change[:-1]) <= 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.select("doc_id", "tag", "text").join(gone, ["doc_id", "tag"], "left").select(
        "doc_id", "text", "at").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
