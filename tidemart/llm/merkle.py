"""A Merkle manifest of a dataset, with proofs, and persistent versions for changed rows.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its number of UTF-8 bytes, a
colon and the value. The leaves of a group (``lang``) ascend by ``doc_id``; level by level every two
consecutive nodes, a last one alone, become the SHA-256 of their hex digests, until one remains, the
group's subroot. The subroots, by group, give the root in the same way.

1. *Positions.* Leaves are range-partitioned by group and id; numbers within a shard and the counts of
   the shards before it give each leaf its position in its group.
2. *Aligned blocks.* 2^``levels`` consecutive positions are one block, a whole subtree: one row with
   its leaves, hashed by one task. The tops of all blocks are the leaves of the next level, in blocks
   again, up to the subroots and the root.
3. *Versions.* The tree is persistent: a changed leaf makes a version of its own, which copies the
   leaf's ancestors in its block and shares every other node. For what lies above the block, the path
   of siblings that the upper levels hand down takes its place: each version goes on copying there, in
   the task of its own block, so that no task sees all versions.

Defined cases: nulls are fields; a null ``doc_id`` comes first in its group; rows with an equal
``doc_id`` are ordered by leaf; a null ``lang`` is a group and comes first, an empty one is another;
empty texts have zero bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.common import cut

#: Levels within a block: a full one has 2^12 leaves.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(columns: dict[str, Column]) -> Column:
    """The digest of a row, from the fields in the order of ``FIELDS``."""
    parts = []
    for name in FIELDS:
        value = columns[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``doc_id``, ``lang``, ``leaf`` and ``changed``: the leaf with some fields replaced, null where
    ``when`` does not hold."""
    fields = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(F.lit(True) if when is None else when, leaf_of(fields | changed))
    return docs.select("doc_id", "lang", leaf_of(fields).alias("leaf"), other.alias("changed"))


# --- positions ----------------------------------------------------------------------

def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the position (from 0) within the group by ``order``, and ``total``, the rows of
    the group. No task sees more than its shard."""
    columns = rows.columns
    names = [c for c in columns if c != group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            numbers = []
            for value in batch.column(group).to_pylist():
                n = n + 1 if value == last else 0
                last = value
                numbers.append(n)
            size = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([shard] * size, pa.int64()),
                 pa.array(numbers, pa.int64())], [*columns, "shard", "number"])

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType()),
                           T.StructField("number", T.LongType())])
    numbered = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .mapInArrow(number, schema), "merkle-numbered")
    shards = numbered.groupBy(group, "shard").agg(F.count("*").alias("n"))
    here = Window.partitionBy(group)  # a row per shard and group
    offsets = shards.select(
        F.col(group).alias("_group"), F.col("shard").alias("_shard"), F.sum("n").over(here).alias("total"),
        (F.sum("n").over(here.orderBy("shard")) - F.col("n")).alias("_before"))
    same = numbered[group].eqNullSafe(F.col("_group")) & (numbered["shard"] == F.col("_shard"))
    return numbered.join(offsets, same).select(
        group, *names, (F.col("_before") + F.col("number")).alias("pos"), "total")


# --- one block ----------------------------------------------------------------------

def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(total: int) -> int:
    """Levels above ``total`` leaves."""
    return (total - 1).bit_length()


def build(digests: list[str], levels: int) -> list[list[str]]:
    """All levels of a block, the leaves first."""
    tree = [digests]
    for _ in range(levels):
        nodes = tree[-1]
        tree.append([_h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)])
    return tree


def siblings(tree: list[list[str]], i: int) -> tuple[str, str]:
    """The siblings of leaf ``i`` bottom up, one after another, and for each level their side: ``L``,
    ``R``, or ``-`` where the node is alone."""
    digests, sides = [], []
    for nodes in tree[:-1]:
        other = i ^ 1
        if other < len(nodes):
            digests.append(nodes[other])
            sides.append("L" if other < i else "R")
        else:
            sides.append("-")
        i >>= 1
    return "".join(digests), "".join(sides)


def copy_path(leaf: str, proof: str, sides: str) -> list[str]:
    """The nodes that the version with ``leaf`` does not share: the leaf and copies of its ancestors."""
    copied, at = [leaf], 0
    for side in sides:
        if side == "-":
            copied.append(_h(copied[-1]))
            continue
        other = proof[at:at + 64]
        at += 64
        copied.append(_h(other, copied[-1]) if side == "L" else _h(copied[-1], other))
    return copied


# --- all blocks ---------------------------------------------------------------------

def _packed(rows: DataFrame, group: str, levels: int) -> DataFrame:
    """One row per block: its children by position, and its top digest."""
    children = F.sort_array(F.collect_list(F.struct("pos", "digest", "changed", "doc_id")))
    block = F.shiftright("pos", levels).alias("block")
    blocks = rows.groupBy(group, block, "total").agg(children.alias("children"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for total, held in zip(batch.column("total").to_pylist(), batch.column("children"), strict=True):
                digests = held.values.field("digest").to_pylist()
                tops.append(build(digests, min(levels, height(total)))[-1][0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (group, "block", "total", "children")), pa.array(tops, pa.string())],
                [group, "block", "total", "children", "top"])

    schema = T.StructType([*blocks.schema.fields, T.StructField("top", T.StringType())])
    return cut(blocks.mapInArrow(run, schema), "merkle-blocks")


def _linked(blocks: DataFrame, group: str, levels: int) -> DataFrame:
    """Blocks with the siblings of their tops up to the subroot (``up``, ``up_sides``), and ``subroot``."""
    widest = blocks.agg(F.max("total")).first()[0]
    if widest is None or widest <= 1 << levels:
        return blocks.withColumns({"up": F.lit(""), "up_sides": F.lit(""), "subroot": F.col("top")})
    nodes = blocks.select(
        group, F.col("block").alias("pos"), F.col("top").alias("digest"), *_plain("bigint"),
        F.shiftright(F.col("total") + ((1 << levels) - 1), levels).alias("total"))
    above = _unpacked(_linked(_packed(nodes, group, levels), group, levels), group, levels).select(
        F.col(group).alias("_group"), F.col("pos").alias("_block"), F.col("proof").alias("up"),
        F.col("sides").alias("up_sides"), "subroot")
    same = blocks[group].eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
    return blocks.join(above, same).drop("_group", "_block")


def _plain(kind: str) -> list[Column]:
    """What only leaves have, for nodes above them."""
    return [F.lit(None).cast("string").alias("changed"), F.lit(None).cast(kind).alias("doc_id")]


def _unpacked(blocks: DataFrame, group: str, levels: int, versions: bool = False) -> DataFrame:
    """A row per child of linked blocks: its whole ``proof`` and ``sides`` up to the end of ``up``, and
    with ``versions`` the nodes that its version copies."""
    kinds, fields = dict(blocks.dtypes), ["pos", "digest", "changed", "doc_id"]
    kept = [group, *(c for c in ("subroot", "root") if c in kinds)]
    doc_id = blocks.schema["children"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total, up, up_sides = (batch.column(c)[i].as_py() for c in ("total", "up", "up_sides"))
                held = batch.column("children")[i].values
                tree = build(held.field("digest").to_pylist(), min(levels, height(total)))
                paths = [siblings(tree, k) for k in range(len(tree[0]))]
                proofs = [(proof + up, sides + up_sides) for proof, sides in paths]
                here = pa.array([0] * len(paths), pa.int32())
                columns = [*(batch.column(c).slice(i, 1).take(here) for c in kept), *map(held.field, fields),
                           pa.array([p for p, _ in proofs], pa.string()), pa.array([s for _, s in proofs], pa.string())]
                if versions:
                    first = [a if b is None else b for a, b in zip(
                        tree[0], held.field("changed").to_pylist(), strict=True)]
                    copied = [copy_path(leaf, *proof) for leaf, proof in zip(first, proofs, strict=True)]
                    columns.append(pa.array(copied, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*kept, *fields, "proof", "sides", *(["copied"] if versions else [])]
    types = {**kinds, "pos": "bigint", "digest": "string", "changed": "string", "doc_id": doc_id,
             "proof": "string", "sides": "string", "copied": "array<string>"}
    return blocks.select(*kept, "total", "children", "up", "up_sides").mapInArrow(
        run, ", ".join(f"`{n}` {types[n]}" for n in names))


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """From the columns of :func:`leaves`: per row ``doc_id``, ``lang``, ``leaf``, ``changed``, ``proof``
    (siblings bottom up), ``sides``, ``subroot``, ``root`` and ``copied``: the nodes that the row's
    version does not share, from its changed leaf to its own root; for an unchanged row its path,
    recomputed from leaf and siblings."""
    named = rows.select("lang", "doc_id", F.col("leaf").alias("digest"), "changed")
    blocks = _linked(_packed(placed(named, "lang", ["doc_id", "digest"]), "lang", levels), "lang", levels)
    subroots = cut(blocks.where("block = 0").select(F.lit(0).alias("all"), "lang", "subroot"), "merkle-subroots")
    tops = placed(subroots, "all", ["lang"]).select(
        "all", "pos", F.col("subroot").alias("digest"), F.lit(None).cast("string").alias("changed"),
        F.col("lang").alias("doc_id"), "total")
    roots = cut(_unpacked(_linked(_packed(tops, "all", levels), "all", levels), "all", levels).select(
        F.col("doc_id").alias("_lang"), F.col("proof").alias("_up"), F.col("sides").alias("_sides"),
        F.col("subroot").alias("root")), "merkle-roots")
    rooted = blocks.join(roots, blocks["lang"].eqNullSafe(F.col("_lang"))).withColumns(
        {"up": F.concat("up", "_up"), "up_sides": F.concat("up_sides", "_sides")})
    return _unpacked(rooted, "lang", levels, versions=True).select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "changed", "proof", "sides", "subroot", "root", "copied")
