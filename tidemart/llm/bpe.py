"""Byte-pair encoding with a pair occurrence index, and decoding.

Texts are cut at white space and the pieces between spaces into words; a word is encoded once per
worker and then looked up. The words that are new in a slice of a partition are laid out in one
array of symbols. ``merge_words`` maps each mergeable pair to all its positions in that array,
applies the ranks that occur in ascending order, and updates the lists of the pairs next to
each merge. Only the vocabulary file is needed; it is not trained or copied.

Normalizing and splitting follow the file's own description (NFC, white space, lower case, the
split pattern). Arrow cuts pieces of Latin letters with or without marks after them, a column at a
time; other pieces of Latin letters, digits and punctuation take a short path; all the rest are
normalized and split by the tokenizer library itself, so that its Unicode tables decide. Special
tokens that occur in a text are single ids, as in the library.

Defined cases: a null or empty text has no ids; a text without words likewise; repeated rows
give repeated rows; a text is encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemart.llm.common import give_back, own_table, slices

#: A table forgets when it has so many words, or so many bytes of them.
_PIECES_KEPT, _BYTES_KEPT = 300_000, 32 << 20
#: Printable ASCII and the letters of Latin-1 and Latin Extended-A: no combining marks, and one
#: lower-case form each, so Python and the library agree on them (U+0130 lowers to two).
_LATIN = regex.compile("[\x21-\x7e¡-¬®-įı-ž]+")
#: Letters of :data:`_LATIN` and ASCII marks after them: one word each, as no word begins with a mark
#: and ends with a letter unless a letter follows.
_PLAIN = "^(?P<stem>[a-zA-ZÀ-ÖØ-öø-įı-ž]+)(?P<tail>[!-/:-@[-`{-~]*)$"


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next
    one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, ranks and the splitting rules of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        #: Left and right symbol of each rank, and what they become.
        self.merges = np.array([(vocab[left], vocab[right], vocab[left + right]) for left, right in model["merges"]],
                               np.uint32).reshape(-1, 3)
        #: A symbol of no pair, and ranks by left symbol * ``base`` + right symbol; of equal pairs the first counts.
        self.gap = max(vocab.values()) + 1
        self.base = self.gap + 1
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate((self.merges[:, 0].astype(np.int64) * self.base + self.merges[:, 1]).tolist()):
            self.ranks.setdefault(pair, rank)
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int64)
        #: Rank of two bytes side by side, the second within a word or at its end; -1: none.
        self.inner_ranks, self.last_ranks = (
            np.array([[self.ranks.get(a * self.base + b, -1) for b in seconds] for a in self.inner.tolist()], np.int32)
            for seconds in (self.inner.tolist(), self.last.tolist()))
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self._special_words = {number: b" " + text.encode() for text, number in self.special.items()}
        tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in [*vocab.items(), *self.special.items()]:
            tokens[number] = token.encode()
        self.token_texts = pa.array(tokens, pa.binary()).cast(pa.string())
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = described["pre_tokenizer"]["pretokenizers"][0]
        self._words = regex.compile(split["pattern"]["Regex"])
        del described, model, vocab, tokens, split  # the library reads the file by itself
        give_back()
        library = Tokenizer.from_file(path)
        self.model = library.model
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str

    def words(self, piece: str) -> list[bytes]:
        """Words of a piece without special tokens, as bytes."""
        if _LATIN.fullmatch(piece):
            piece = piece.lower()
            if piece.isalpha():
                return [piece.encode()]
            if piece[-1] in ",." and piece[:-1].isalpha():
                return [piece[:-1].encode(), piece[-1].encode()]
            return [w.encode() for w in self._words.findall(piece)]
        back = {s: b for b, s in enumerate(byte_symbols())}
        return [bytes(back[c] for c in word)
                for word, _ in self._split(self._normalize(piece))]

    def parts(self, piece: str) -> list[bytes | int]:
        """Words and special ids of a piece, in order."""
        if "<|" not in piece:
            return self.words(piece)
        out: list[bytes | int] = []
        for part in self._cut.split(piece):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.words(part))
        return out


    def cut(self, pieces: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different words of pieces, the place in that list of each piece's words, one piece after
        another, and how many each has. A special token comes as a space and its text."""
        found = pc.extract_regex(pieces, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        found = found.drop_null()
        tails = found.field("tail")
        tailed = pc.not_equal(tails, "")
        others = [[w if isinstance(w, bytes) else self._special_words[w] for w in self.parts(piece)]
                  for piece in pieces.filter(pa.array(~plain)).to_pylist()]
        counts = np.empty(len(pieces), np.int64)
        counts[plain] = 1 + tailed.to_numpy(zero_copy_only=False)
        counts[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        starts = np.cumsum(counts) - counts
        stems = starts[plain]
        words = pa.concat_arrays([
            pc.utf8_lower(found.field("stem")).cast(pa.binary()), tails.filter(tailed).cast(pa.binary()),
            pa.array([w for words in others for w in words], pa.binary())]).dictionary_encode()
        codes = np.empty(len(words), np.int64)
        codes[np.concatenate([stems, stems[counts[plain] == 2] + 1, stretches(starts[~plain], counts[~plain])])
              ] = words.indices.to_numpy()
        return words.dictionary.to_pylist(), codes, counts


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its size, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word. All words share one symbol array, and one index of pairs."""
    if not words:
        return []
    # a place that is no symbol before, between and after the words: no pair has it
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    gaps = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
    first = vocabulary.inner[raw]
    first[gaps[1:] - 1] = vocabulary.last[raw[gaps[1:] - 1]]
    first[gaps] = vocabulary.gap
    found = vocabulary.inner_ranks[raw[:-1], raw[1:]]
    found[gaps[1:] - 2] = vocabulary.last_ranks[raw[gaps[1:] - 2], raw[gaps[1:] - 1]]
    found[gaps[1:] - 1] = found[gaps[:-1]] = -1

    places_found = np.flatnonzero(found >= 0)
    found = found[places_found]
    order = np.argsort(found, kind="stable")
    found, places_found = found[order], places_found[order].tolist()
    bounds = [*np.flatnonzero(np.diff(found, prepend=-1)).tolist(), len(found)]
    active = found[bounds[:-1]].tolist()  # ascending, so a heap
    positions = {rank: places_found[a:b]  # rank -> places of its pair
                 for rank, a, b in zip(active, bounds, bounds[1:], strict=False)}

    symbols = first.tolist()
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    merges, rank_of, base = vocabulary.merges, vocabulary.ranks.get, vocabulary.base
    while active:
        rank = heapq.heappop(active)
        places = positions.pop(rank, None)
        if places is None:
            continue
        left, right, merged = merges[rank].tolist()
        merged_first = merged * base
        places.sort()
        for done, i in enumerate(places):
            j = after[i]
            if symbols[i] != left or symbols[j] != right:
                continue  # a merge before took one of the two
            k, h = after[j], before[i]
            symbols[i], symbols[j], after[i], before[k] = merged, -1, k, i
            lower = False
            new = rank_of(merged_first + symbols[k])
            if new is not None:
                if new in positions:
                    positions[new].append(i)
                else:
                    heapq.heappush(active, new)
                    positions[new] = [i]
                lower = new < rank
            new = rank_of(symbols[h] * base + merged)
            if new is not None:
                if new in positions:
                    positions[new].append(h)
                else:
                    heapq.heappush(active, new)
                    positions[new] = [h]
                lower |= new < rank
            if lower and done + 1 < len(places):  # the new pair goes first, then the rest of this one
                rest = places[done + 1:]
                if rank in positions:
                    positions[rank].extend(rest)
                else:
                    positions[rank] = rest
                    heapq.heappush(active, rank)
                break

    merged_symbols = np.array(symbols)
    left_over = (merged_symbols >= 0) & (merged_symbols != vocabulary.gap)
    ends = np.cumsum(left_over)[gaps].tolist()
    ids = merged_symbols[left_over].tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def side_by_side(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for each in ids for x in each), np.uint32, int(sizes.sum())), sizes


class WordTable:
    """Ids of words, each encoded once while the table has room."""

    def __init__(self, vocabulary: Vocabulary, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        """``encode`` gives the ids of words one after another, and how many each has."""
        self._vocabulary, self._encode = vocabulary, encode
        self._reset()

    def _reset(self) -> None:
        special = self._vocabulary.special
        self._numbers = {b" " + text.encode(): n for n, text in enumerate(special)}
        self._bytes = 0
        self._flat = np.array(list(special.values()), np.uint32)
        self._sizes = np.ones(len(special), np.int64)
        self._starts = np.arange(len(special))
        self._uses = np.zeros(len(special), np.int64)

    def _add(self, new: list[bytes]) -> None:
        if not new:
            return
        flat, sizes = self._encode(new)
        n = len(self._numbers)
        self._numbers.update(zip(new, range(n, n + len(new)), strict=True))
        self._bytes += sum(map(len, new))
        self._sizes = np.concatenate([self._sizes, sizes])
        self._flat = np.concatenate([self._flat, flat])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._uses = np.concatenate([self._uses, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Keep the special tokens and the words that were seen most, half the room at most."""
        n_special = len(self._vocabulary.special)
        room = min(_PIECES_KEPT // 2, len(self._uses) - n_special)
        most = n_special + np.argsort(self._uses[n_special:], kind="stable")[::-1][:room]
        kept = np.concatenate([np.arange(n_special), np.sort(most)])
        names = list(self._numbers)
        sizes = self._sizes[kept]
        self._flat = self._flat[stretches(self._starts[kept], sizes)]
        self._numbers = {names[i]: n for n, i in enumerate(kept.tolist())}
        self._sizes, self._starts, self._uses = sizes, np.cumsum(sizes) - sizes, self._uses[kept] // 2
        self._bytes = sum(map(len, self._numbers))
        if self._bytes > _BYTES_KEPT // 2:
            self._reset()

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of each text. Arrow cuts the column,
        numbers its different pieces and those their different words, so Python looks at each of those
        once a column, however often they occur."""
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        words, word_codes, n_words = self._vocabulary.cut(coded.dictionary)
        if len(self._numbers) > _PIECES_KEPT or self._bytes > _BYTES_KEPT:
            self._forget()
        self._add([w for w in words if w not in self._numbers])
        number_of = np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))
        uses = np.repeat(np.bincount(codes, minlength=len(n_words)), n_words)
        self._uses[number_of] += np.bincount(word_codes, uses, len(words)).astype(np.int64)
        # ids of the column's own pieces side by side, then each piece's stretch of them
        numbers = number_of[word_codes]
        own = self._flat[stretches(self._starts[numbers], self._sizes[numbers])]
        ends = np.concatenate([[0], np.cumsum(self._sizes[numbers])])[np.concatenate([[0], np.cumsum(n_words)])]
        each = np.diff(ends)[codes]
        ids = own[stretches(ends[:-1][codes], each)]
        upto = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(upto)

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_column`, for a list of texts."""
        return self.encode_column(pa.array(batch, pa.binary()).cast(pa.string()))


def pair_index_table(path: str) -> tuple[WordTable, Vocabulary]:
    """One for all tasks of a worker, until it serves another operator."""
    return own_table(("pieces", path), lambda: _pair_index_table(path))


def _pair_index_table(path: str) -> tuple[WordTable, Vocabulary]:
    vocabulary = Vocabulary(path)
    give_back()
    return WordTable(vocabulary, lambda words: side_by_side(merge_words(words, vocabulary))), vocabulary


def decode(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The tokens of each text joined by a space: the file names no decoder."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    tokens = vocabulary.token_texts.take(pa.array(ids.astype(np.int32)))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = pair_index_table(path)
        for batch in slices(batches, "text"):
            ids, sizes = table.encode_column(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))],
                ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded`` (from the ids) of every text, and
    ``ids`` if wanted; in one pass, so one Python worker a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocabulary = pair_index_table(path)
        for batch in slices(batches, "text", 2_000_000):
            ids, sizes = table.encode_column(batch.column("text"))
            raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(sizes)
            columns = [
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest()
                          for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)], pa.string()),
                decode(ids, sizes, vocabulary)]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded"] + ["ids"] * keep_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded string"
        + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``decoded`` from ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = pair_index_table(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), decode(ids.flatten().to_numpy(zero_copy_only=False), sizes, vocabulary)],
                    ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
