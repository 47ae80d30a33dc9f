"""The prefix trie of conversations, with figures for every node.

A turn is known by the first 16 bytes of the SHA-256 of its role and text, a conversation by the
bytes of its turns one after another. Bytes sort as sequences of turns do, a prefix before what
continues it, so a node (all conversations that begin with the same turns) is one stretch of rows.

1. *Fold.* Conversations with equal turns become one row: their number and their least id, combined
   on the map side. The ids that end at a node are hashed in ascending order as a stream of pieces
   (``_ends``); a list of them never exists.
2. *Shards.* The rows are range-partitioned and sorted by their turns. A task cuts its shard into
   blocks of about ``CELLS`` cells. In a block the turns get dense ids in a padded matrix, lexsort
   puts the rows in order, changes between neighbours are OR-accumulated over the columns and so
   mark where nodes start, and reduceat over these starts gives the figures of all depths at once.
3. *Boundaries.* Only prefixes of a block's first and last row can go on in another block. These two
   paths leave the block as rows of partial figures per depth. They go through step 2 again, where
   partial figures are added, until one block holds them all: each level has at most an eighth of the
   rows of the one before.
4. *Parents.* The children of boundary nodes learn their parent's id by a join.

Defined cases: turns ascend by ``turn``, a null turn first, equal ones by role, then by the digest of
role and text; repeated rows all stay; null role or text is empty; rows with a null ``conv_id`` belong
to no conversation and are left out; other columns are ignored; an empty table gives no nodes,
not even a root. The turn digests of one conversation have to fit into one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.common import WORD_PATTERN, cut

ID_BYTES = 16
#: Cells of a block's matrix; a block has LEAST_ROWS rows at least, so that levels shrink.
CELLS, LEAST_ROWS = 1_000_000, 16
#: The range partitioner samples keys on the driver: they are cut to so many bytes (64 turns).
KEY_BYTES = 64 * ID_BYTES
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PATH = [("path", pa.binary()), ("words", pa.list_(pa.int32()))]
_PARTS = [(name, pa.list_(pa.int64())) for name in ("n", "least", "kids", "leaves", "saved")]
_OPEN = [*_PATH, *_PARTS, ("ends", pa.list_(pa.string())), ("keys", pa.list_(pa.binary()))]
_NODE = [("key", pa.binary()), ("parent_key", pa.binary()), ("turn_id", pa.binary()),
         *((name, pa.int64()) for name in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                                           "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]
_OUT = pa.schema([*_NODE, *((f"open_{name}", kind) for name, kind in _OPEN)])
_DDL = ("key binary, parent_key binary, turn_id binary, depth bigint, conv_id bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, "
        "open_path binary, open_words array<int>, open_n array<bigint>, open_least array<bigint>, "
        "open_kids array<bigint>, open_leaves array<bigint>, open_saved array<bigint>, "
        "open_ends array<string>, open_keys array<binary>")


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: (id as 32 hex digits, words) of each turn, in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
            "turn", role.alias("role"), F.substring(digest, 1, 2 * ID_BYTES).alias("id"),
            F.regexp_count(text, F.lit(WORD_PATTERN)).cast("int").alias("words")).alias("row"))
    # placed by the run of twenty that rebuilt() looks at, so that it needs no further shuffle
    placed = rows.withColumn("run", _run(F.col("conv_id"))).repartition("run")
    return (placed.groupBy("run", "conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
            .select("run", "conv_id", F.transform("rows", lambda r: F.struct(r["id"], r["words"])).alias("turns")))


def _run(conv_id: Column) -> Column:
    return conv_id - conv_id % 20


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns, h = crc32(c) % 4, taken from the conversation
    c - c % 20 (as many as that has; none if it is absent)."""
    own = F.col("turns")
    head = F.when(F.col("conv_id") == F.col("run"), F.slice(own, 1, 3))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    first = F.max(head).over(Window.partitionBy("run"))  # one row of at most 39 has it
    empty = F.slice(own, 1, 0)
    return convs.select("conv_id", F.concat(F.slice(F.coalesce(first, empty), F.lit(1), h),
                                            F.slice(own, h + 1, F.size(own))).alias("turns"))


# --- ids that end at a node ---------------------------------------------------------

def _ends(members: DataFrame) -> DataFrame:
    """(path_id, ends): the SHA-256 of the ascending ``conv_id`` of each ``path_id``, comma-joined.

    Ranges of ids are joined to pieces of text first, so the task that hashes a path that a third of
    all conversations share reads a few long pieces, one after another.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("path_id").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a, _ in spans], pa.string()),
                 pa.array([ids[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())],
                ["path_id", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least, running = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for path_id, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path_id != name:
                    if name is not None:
                        out.append((least, running.hexdigest()))
                    name, least, running = path_id, first, hashlib.sha256(ids.encode())
                else:
                    running.update(f",{ids}".encode())
            yield _rows(out)
        if name is not None:
            yield _rows([(least, running.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())],
            ["least", "ends"])

    ranged = members.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id")
    joined = (ranged.sortWithinPartitions("path_id", "conv_id")
              .mapInArrow(pieces, "path_id string, first bigint, ids string"))
    return (joined.repartition("path_id").sortWithinPartitions("path_id", "first")
            .mapInArrow(digests, "least bigint, ends string"))


# --- one block ----------------------------------------------------------------------

def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _turn_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Turns per row, and the ids of all rows one after another as two numbers each."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64) // ID_BYTES
    data = b"".join(column.to_pylist())
    return sizes, np.frombuffer(data, ">u8").reshape(-1, 2).astype(np.uint64)


@dataclass
class Cells:
    """Figures of a block, by row and depth, before its rows are ordered."""
    n: np.ndarray
    least: np.ndarray
    kids: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    words: np.ndarray
    ends: list[tuple[int, int, str]]  # (row, depth, digest)
    keys: dict[tuple[int, int], bytes] | None


def _ragged(values: np.ndarray, sizes: np.ndarray, width: int, first: int) -> np.ndarray:
    """Rows of ``sizes`` values each, from column ``first`` on; zero elsewhere."""
    out = np.zeros((len(sizes), width), values.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first] = values
    return out


def _cells(block: pa.RecordBatch, sizes: np.ndarray, width: int) -> Cells:
    n_rows = len(sizes)
    words = _ragged(_flat(block.column("words")).astype(np.int64), sizes, width, 1)
    if "conv_id" in block.schema.names:  # whole conversations
        def every(name: str) -> np.ndarray:
            return np.repeat(block.column(name).to_numpy()[:, None], width, axis=1)
        nothing = np.zeros((n_rows, width), np.int64)
        ends = [(r, int(sizes[r]), e) for r, e in enumerate(block.column("ends").to_pylist())]
        return Cells(every("n"), every("conv_id"), nothing, nothing, nothing, words, ends, None)
    parts = {name: _ragged(_flat(block.column(name)), sizes + 1, width, 0) for name, _ in _PARTS}
    parts["least"][parts["n"] == 0] = np.iinfo(np.int64).max
    listed, keys = block.column("ends").to_pylist(), block.column("keys").to_pylist()
    ends = [(r, d, e) for r, row in enumerate(listed) for d, e in enumerate(row) if e is not None]
    return Cells(**parts, words=words, ends=ends,
                 keys={(r, d): k for r, row in enumerate(keys) for d, k in enumerate(row)})


def _prefix_keys(path: bytes) -> list[bytes]:
    """A short name of every prefix, the empty one first."""
    running = hashlib.sha256()
    out = [running.digest()[:ID_BYTES]]
    for at in range(0, len(path), ID_BYTES):
        running.update(path[at:at + ID_BYTES])
        out.append(running.digest()[:ID_BYTES])
    return out


def trie_block(block: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """The closed nodes of a block, and the paths of its first and last row with partial figures.
    ``last``: there is no other block, so all nodes are closed."""
    sizes, ids = _turn_ids(block.column("path"))
    rows, width = len(sizes), int(sizes.max()) + 1
    by_id = np.lexsort((ids[:, 1], ids[:, 0]))
    ordered = ids[by_id]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    dense = np.empty(len(ids), np.int32)
    dense[by_id] = np.cumsum(fresh)
    matrix = _ragged(dense, sizes, width, 1)  # 0: no turn
    matrix[:, 0] = 1  # the root
    cells = _cells(block, sizes, width)
    order = np.lexsort(matrix.T[::-1])
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    matrix, sizes = matrix[order], sizes[order]
    ids_of = np.cumsum(fresh) - 1

    starts = np.ones((rows, width), bool)
    starts[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    real = (matrix != 0).T.ravel()
    at = np.flatnonzero(starts.T.ravel())  # stretches of equal prefixes, depth by depth
    number = np.cumsum(real[at]) - 1
    of_cell = np.where(real, number[np.cumsum(starts.T.ravel()) - 1], -1)

    def down(name: str) -> np.ndarray:
        return getattr(cells, name)[order].T.ravel()

    kept = real[at]
    depth, row = at[kept] // rows, at[kept] % rows
    end = np.append(at[1:], rows * width)[kept] - depth * rows
    count = np.add.reduceat(down("n"), at)[kept]
    least = np.minimum.reduceat(down("least"), at)[kept]
    kids = np.add.reduceat(down("kids"), at)[kept]
    sub_leaves = np.add.reduceat(down("leaves"), at)[kept]
    sub_saved = np.add.reduceat(down("saved"), at)[kept]
    parent = np.where(depth > 0, of_cell[(depth - 1) * rows + row], -1)
    total = len(depth)
    words = cells.words[order][row, depth]
    ends = np.full(total, None, object)
    for r, d, digest in cells.ends:
        ends[of_cell[d * rows + place[r]]] = digest

    open_ = np.zeros(total, bool)
    if not last:
        for edge in (0, rows - 1):
            open_[of_cell[np.arange(sizes[edge] + 1) * rows + edge]] = True
    below = depth > 0
    closed_child = below & ~open_
    children = kids + np.bincount(parent[below], minlength=total).astype(np.int64)
    # sums over a subtree: its rows, from the node's depth on in the first of them
    own_leaves = sub_leaves + (children == 0)
    own_saved = sub_saved + (count - 1) * words
    leaves, saved = (_subtree(np.where(open_, 0, own), depth, row, end, rows, width)
                     for own in (own_leaves, own_saved))
    turn_id = [None] * total
    flat = ordered[fresh].astype(">u8").tobytes()
    for i in np.flatnonzero(below):
        j = int(matrix[row[i], depth[i]]) - 1
        turn_id[i] = flat[j * ID_BYTES:(j + 1) * ID_BYTES]

    path = block.column("path").to_pylist()
    names: dict[int, bytes] = {}
    if cells.keys is not None:
        for (r, d), key in cells.keys.items():
            names[int(of_cell[d * rows + place[r]])] = key
    else:
        for edge in {0, rows - 1} if not last else ():
            for d, key in enumerate(_prefix_keys(path[order[edge]])):
                names[int(of_cell[d * rows + edge])] = key
    closed = np.flatnonzero(~open_)
    waits = (parent >= 0) & open_[np.maximum(parent, 0)]
    nodes = {
        "key": [names.get(int(i)) for i in closed] if cells.keys is not None else [None] * len(closed),
        "parent_key": [names[int(parent[i])] if waits[i] else None for i in closed],
        "turn_id": [turn_id[i] for i in closed], "depth": depth[closed], "conv_id": least[closed],
        "parent_conv_id": [int(least[parent[i]]) if parent[i] >= 0 and not waits[i] else None for i in closed],
        "n_convs": count[closed], "n_children": children[closed], "n_leaves": leaves[closed],
        "saved_tokens": saved[closed], "ends_sha256": [NO_ENDS if e is None else e for e in ends[closed]]}
    opened: dict[str, list] = {name: [] for name, _ in _OPEN}
    if not last:
        # figures that an open node gets from the closed nodes right below it, in no other block
        hang = np.flatnonzero(closed_child & waits)
        kids = kids + np.bincount(parent[hang], minlength=total).astype(np.int64)
        sub_leaves, sub_saved = sub_leaves.copy(), sub_saved.copy()
        np.add.at(sub_leaves, parent[hang], leaves[hang])
        np.add.at(sub_saved, parent[hang], saved[hang])
        told = np.zeros(total, bool)
        for edge in ([0] if rows == 1 else [0, rows - 1]):
            mine = of_cell[np.arange(sizes[edge] + 1) * rows + edge]
            if told[mine].all():
                continue
            here = ~told[mine]  # each node's figures go with one path
            told[mine] = True
            opened["path"].append(path[order[edge]])
            opened["words"].append(words[mine[1:]].tolist())
            for name, values in (("n", count), ("least", least), ("kids", kids), ("leaves", sub_leaves),
                                 ("saved", sub_saved)):
                opened[name].append(np.where(here, values[mine], 0).tolist())
            opened["ends"].append([e if h else None for e, h in zip(ends[mine], here, strict=True)])
            opened["keys"].append([names[int(i)] for i in mine])
    m, k = len(closed), len(opened["path"])
    return pa.RecordBatch.from_arrays(
        [*(pa.concat_arrays([pa.array(nodes[name], kind), pa.nulls(k, kind)]) for name, kind in _NODE),
         *(pa.concat_arrays([pa.nulls(m, kind), pa.array(opened[name], kind)]) for name, kind in _OPEN)],
        schema=_OUT)


def _subtree(own: np.ndarray, depth: np.ndarray, row: np.ndarray, end: np.ndarray, rows: int,
             width: int) -> np.ndarray:
    """Sum of ``own`` over each node's subtree. What starts in a later row of the node lies below
    it; of its first row, what lies at its depth or deeper does."""
    grid = np.zeros((rows, width), np.int64)
    grid[row, depth] = own
    tail = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
    before = np.concatenate([[0], np.cumsum(tail[:, 0])])
    return tail[row, depth] + before[end] - before[row + 1]


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows whose padded matrix has about ``cells`` cells."""
    held: pa.Table | None = None

    def length(table: pa.Table) -> int:
        size = pc.binary_length(table.column("path")).to_numpy() // ID_BYTES
        full = (np.arange(len(size)) + 1) * np.maximum.accumulate(size + 1)
        return max(LEAST_ROWS, int(np.searchsorted(full, cells, "right")))

    def whole(table: pa.Table) -> pa.RecordBatch:
        return table.combine_chunks().to_batches(max_chunksize=table.num_rows)[0]

    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        while held.num_rows:
            n = length(held)
            if n >= held.num_rows:
                break
            yield whole(held.slice(0, n))
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield whole(held)


# --- all blocks ---------------------------------------------------------------------

def _level(rows: DataFrame, last: bool, cells: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in [_all(batches)] if last else _blocks(batches, cells):
            if block is not None:
                yield trie_block(block, last)

    def _all(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return None
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    if last:  # as many rows as one block holds
        return rows.coalesce(1).mapInArrow(run, _DDL)
    key = F.substring("path", 1, KEY_BYTES)
    return rows.repartitionByRange(key).sortWithinPartitions("path").mapInArrow(run, _DDL)


def prefix_trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the conversations ``(conv_id, turns)`` of :func:`conversations`: ``depth``,
    ``conv_id`` (the least member's), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` and ``turn_id``, the id of the node's last turn."""
    paths = cut(convs.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"),
                             F.col("turns.words").alias("words")), "trie-paths")
    alone = F.sha2(F.col("conv_id").cast("string"), 256)
    folded = cut(paths.groupBy("path", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "trie-folded")
    path_id = F.sha2("path", 256).alias("path_id")
    shared = folded.where("n > 1").select(path_id)
    ends = _ends(paths.select(path_id, "conv_id").join(shared, "path_id", "left_semi"))
    rows = (folded.join(ends, (folded["n"] > 1) & (folded["conv_id"] == ends["least"]), "left")
            .select("path", "words", "conv_id", "n", F.coalesce("ends", alone).alias("ends")))
    levels = []
    while True:
        size = rows.select(F.count("*").alias("rows"), F.coalesce(F.max(F.octet_length("path")), F.lit(0)).alias("bytes")).first()
        last = size["rows"] <= LEAST_ROWS or size["rows"] * (size["bytes"] // ID_BYTES + 1) <= cells
        done = cut(_level(rows, last, cells), "trie-level")
        levels.append(done.where("depth IS NOT NULL").select(*(name for name, _ in _NODE)))
        if last:
            break
        rows = done.where("open_path IS NOT NULL").select(*(F.col(f"open_{name}").alias(name) for name, _ in _OPEN))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    boundary = nodes.where("key IS NOT NULL").select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    return (nodes.join(boundary, "parent_key", "left")
            .select("depth", "conv_id", F.coalesce("parent_conv_id", "found").alias("parent_conv_id"), "n_convs",
                    "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.lower(F.hex("turn_id")).alias("turn_id")))
