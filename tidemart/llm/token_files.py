"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is laid out after the public Zstandard seekable format::

    frame, frame, ...        ids of whole documents, little-endian, each frame on its own
    skippable frame          document index: doc_id, number of ids and frame of every document
    skippable frame          seek table: compressed size, size and XXH64 (low 32 bits) per frame

Any zstandard tool can decompress such a file; a reader that wants one document reads the end of
the file, the index and the one frame that holds it, and checks the frame's checksum.

Documents are dealt into ranges of ``doc_id`` (bounds from a quantile sketch of the id column
alone) and sorted within each range, so file after file the order is ascending. Tasks write to
names of their own and report them; only the names that Spark committed in the manifest count,
so a lost or repeated task leaves at most a file that nobody reads.

Ids take two bytes where the vocabulary allows it, else four. Encoding is by the model of the
tokenizer library; since no token of its split pattern spans white space, texts are cut there and
into words, and each word is encoded once per worker and then looked up.

Defined cases: a null or empty text has only the end id; rows with equal ``doc_id`` stand next
to each other, ordered by their ids; a null ``doc_id`` comes first; an empty table gives no
files; other columns are ignored.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidemart.llm.bpe import Vocabulary, WordTable, byte_symbols
from tidemart.llm.common import cut, slices
from tidemart.session import new_folder

# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: A frame is closed after the document that takes it to this many bytes.
FRAME_BYTES = 1 << 20
_NO_ID = -(1 << 63)


@cache
def library_table(path: str) -> WordTable:
    """Words by the tokenizer library: its model encodes each new word of a slice once."""
    vocabulary = Vocabulary(path)
    symbols = str.maketrans(dict(enumerate(byte_symbols())))
    tokenize = vocabulary.model.tokenize

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = array("I"), array("q")
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the many small lists would be searched in vain
        try:
            for word in words:
                text = word.decode("latin-1")
                flat.extend([t.id for t in tokenize(text if word.isascii() and word.isalpha() else text.translate(symbols))])
                ends.append(len(flat))
        finally:
            if collecting:
                gc.enable()
        return np.frombuffer(flat, np.uint32).copy(), np.diff(np.frombuffer(ends, np.int64), prepend=0)

    return WordTable(vocabulary, encode)


class FrameWriter:
    """Writes one file; documents have to come in order."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES) -> None:
        self._out, self._width, self._most = out, width, frame_bytes
        self._pack = zstandard.ZstdCompressor(level=3)
        self._parts: list[bytes] = []
        self._held = 0
        self._seek: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((_NO_ID if doc_id is None else doc_id, len(ids) // self._width,
                           len(self._seek)))
        self._parts.append(ids)
        self._held += len(ids)
        if self._held >= self._most:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self._parts)
        packed = self._pack.compress(raw)
        self._out.write(packed)
        self._seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._parts, self._held = [], 0

    def close(self) -> tuple[int, int]:
        if self._parts:
            self._close_frame()
        docs = np.array(self._docs, np.int64).reshape(-1, 3)
        body = struct.pack("<BQ", self._width, len(docs)) + self._pack.compress(
            docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype("<u8").tobytes()
            + docs[:, 2].astype("<u4").tobytes())
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        entries = [*self._seek, (8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        table += struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_END)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        return len(docs), int(docs[:, 1].sum())


class FrameReader:
    """Reads one file by its seek table; frames are read and checked one at a time."""

    def __init__(self, file) -> None:
        self._file = file
        self._unpack = zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEK_END or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self._seek = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self._starts = np.cumsum(self._seek[:, 0]) - self._seek[:, 0]
        body = self._at(int(self._starts[-1]) + 8, int(self._seek[-1, 0]) - 8)
        self.width, n_docs = struct.unpack_from("<BQ", body)
        raw = self._unpack.decompress(body[9:])
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs)
        self.sizes = np.frombuffer(raw, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.frames = np.frombuffer(raw, "<u4", n_docs, 16 * n_docs)
        self.frames_read = 0

    def _at(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        return self._file.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self._seek[k].tolist()
        raw = self._unpack.decompress(self._at(int(self._starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum does not match")
        self.frames_read += 1
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids), in order; only frames of wanted documents."""
        before = np.cumsum(self.sizes) - self.sizes
        bounds = [0, *(np.flatnonzero(np.diff(self.frames)) + 1).tolist(), len(self.frames)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b or wanted is not None and wanted.isdisjoint(self.doc_ids[a:b].tolist()):
                continue
            ids, at = self.frame(int(self.frames[a])), 0
            for i in range(a, b):
                doc = int(self.doc_ids[i])
                if wanted is None or doc in wanted:
                    yield None if doc == _NO_ID else doc, int(before[i]), ids[at:at + self.sizes[i]]
                at += int(self.sizes[i])


def _range_of(docs: DataFrame, n_files: int) -> F.Column:
    """Number of the range that ``doc_id`` falls in; bounds from a sketch of the id column."""
    steps = [i / n_files for i in range(1, n_files)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] if steps else None
    cuts = sorted(set(bounds or []))
    if not cuts:
        return F.lit(0)
    ranks = F.array(*[F.lit(int(x)) for x in cuts])
    return F.coalesce(F.size(F.filter(ranks, lambda x: x < F.col("doc_id"))), F.lit(0))


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None,
                      n_files: int | None = None) -> DataFrame:
    """Encode, write, and return the manifest: ``file_no``, ``file``, ``n_docs``, ``n_tokens``
    and ``start`` (ids in all files before)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library_table(path)
        for batch in slices(batches, "text"):
            ids, sizes = known.encode_column(batch.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
            column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
                None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("file_no"),
                 column.cast(pa.binary())], ["doc_id", "file_no", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = number = None
        for batch in batches:
            for doc, file_no, ids in zip(batch.column("doc_id").to_pylist(),
                                         batch.column("file_no").to_pylist(),
                                         batch.column("ids").to_pylist(), strict=True):
                if file_no != number:
                    if writer:
                        yield done(writer, out, number, name)
                    number, name = file_no, f"{file_no:06d}-{uuid.uuid4().hex}.ids.zst"
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = FrameWriter(out, width)
                writer.add(doc, ids)
        if writer:
            yield done(writer, out, number, name)

    def done(writer, out, number, name) -> pa.RecordBatch:
        n_docs, n_tokens = writer.close()
        out.close()
        return pa.RecordBatch.from_pylist([{
            "file_no": number, "file": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": n_tokens}],
            pa.schema([("file_no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                       ("n_tokens", pa.int64())]))

    ranged = docs.select("doc_id", "text", _range_of(docs, n_files).alias("file_no"))
    encoded = ranged.mapInArrow(encode, "doc_id bigint, file_no int, ids binary")
    manifest = cut(encoded.repartitionById(n_files, "file_no")
                   .sortWithinPartitions("file_no", "doc_id", "ids")
                   .mapInArrow(write, "file_no int, file string, n_docs bigint, n_tokens bigint"),
                   "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(),
                                   batch.column("start").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as opened:
                    rows = []
                    for doc, before, ids in FrameReader(opened).documents():
                        rows.append((doc, start + before, len(ids),
                                     zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield as_batch(rows)
                            rows = []
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (manifest.select("file_no", "file", "start").repartitionById(n, F.col("file_no") % n)
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: set[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of the named documents; only their frames are decompressed."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as opened:
                    for doc, _, ids in FrameReader(opened).documents(doc_ids):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))],
                            ["doc_id", "ids"])

    return manifest.select("file").mapInArrow(read, "doc_id bigint, ids array<bigint>")
