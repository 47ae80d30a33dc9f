import hashlib
import json
import random
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemart.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rnd = random.Random(1)
    texts = ["", "   ", "a\x0bb\x0cc\x1cd\x85e\x00f", "<|endoftext|>", "x<|startoftext|>y <|endoftext",
             "Σίσυφος ΟΔΟΣ.", "İstanbul, ı", "é ² ½ x³", "don't I'LL we'RE 's's 'd.", "中文字符，测试。",
             "a,. b., ..,", "aaaaaaaaa abababab " * 30, "x" * 5000]
    texts += ["".join(map(chr, range(a, a + 40))) for a in range(0x21, 0x180, 40)]
    texts += ["".join(rnd.choice("abcdeinthersoAÉéß .,'0#<|>\n😀aaa") for _ in range(rnd.randint(0, 40)))
              for _ in range(1500)]
    return texts


@pytest.mark.parametrize("table", [lambda: bpe.pair_index_table(PATH)[0],
                                   lambda: token_files.library_table(PATH)])
def test_pieces_encode_as_the_library_does(table, monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES_KEPT", 500)  # the table forgets in between
    texts = odd_texts()
    for a in range(0, len(texts), 400):
        part = texts[a:a + 400]
        ids, sizes = table().encode([t.encode() for t in part])
        ends = np.cumsum(sizes)
        for text, begin, end in zip(part, ends - sizes, ends, strict=True):
            assert ids[begin:end].tolist() == ids_of(text), text


def test_latin_letters_take_one_path():
    vocabulary = bpe.Vocabulary(PATH)
    for code in range(0x21, 0x180):
        if bpe._LATIN.fullmatch(chr(code)):
            text = f"a{chr(code)}b"
            back = {s: b for b, s in enumerate(bpe.byte_symbols())}
            want = [bytes(back[c] for c in w) for w, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(
                LIBRARY.normalizer.normalize_str(text))]
            assert vocabulary.words(text) == want, hex(code)


def test_merges_follow_rank_order_not_text_order():
    vocabulary = bpe.Vocabulary(PATH)
    words = [w.encode() for w in ("aaaa", "ababab", "thethe", "internationalization", "q", "zzzzzzz")]
    assert bpe.merge_words(words, vocabulary) == [ids_of(w.decode()) for w in words]
    assert bpe.merge_words([], vocabulary) == []


@pytest.mark.parametrize("table", [lambda: bpe._pair_index_table(PATH)[0],
                                   lambda: token_files.library_table.__wrapped__(PATH)])
def test_columns_encode_as_the_library_does(table):
    """Marks and letters of many alphabets at each place of a piece; nulls, and a slice of a column."""
    table = table()
    texts = [None, "", " a ", "don' we'll' x's' a<|b a<| <|endoftext|>a <|endoftext|><|endoftext|>,"]
    texts += [f"a{c}b {c}A Z{c} Z{c}.,' {c}{c} 1{c}\tÉ{c}" for c in map(chr, range(0x21, 0x600))]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    for _ in range(2):  # the second time all words are known
        ids, sizes = table.encode_column(column)
        ends = np.cumsum(sizes)
        for text, begin, end in zip(texts, ends - sizes, ends, strict=True):
            assert ids[begin:end].tolist() == ids_of(text), text


def test_pair_index_encodes_a_word_once_whatever_stands_around_it(monkeypatch):
    given, merge = [], bpe.merge_words
    monkeypatch.setattr(bpe, "merge_words", lambda words, v: given.extend(words) or merge(words, v))
    table = bpe._pair_index_table(PATH)[0]
    for text in ("Harbour, harbour.", "HARBOUR harbour,", "harbour <|endoftext|>harbour"):
        table.encode_column(pa.array([text]))
    assert sorted(given) == [b",", b".", b"harbour"]


def test_library_encodes_a_word_once_whatever_stands_around_it(monkeypatch):
    given = []

    class Counting(bpe.Vocabulary):
        def __init__(self, path):
            super().__init__(path)
            tokenize = self.model.tokenize
            self.model = SimpleNamespace(tokenize=lambda word: given.append(word) or tokenize(word))

    monkeypatch.setattr(token_files, "Vocabulary", Counting)
    table = token_files.library_table.__wrapped__(PATH)
    for text in ("Harbour, harbour.", "HARBOUR harbour,", "harbour <|endoftext|>harbour"):
        table.encode_column(pa.array([text]))
    assert sorted(given) == [",", ".", "harbour"]


def test_a_full_table_keeps_special_tokens_and_the_words_seen_most(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES_KEPT", 6)
    given, merge = [], bpe.merge_words
    monkeypatch.setattr(bpe, "merge_words", lambda words, v: given.extend(words) or merge(words, v))
    table = bpe._pair_index_table(PATH)[0]
    for text in ("often often often a b c d e", "<|endoftext|> often a", "often"):
        ids, _ = table.encode_column(pa.array([text]))
        assert ids.tolist() == ids_of(text)
    assert given.count(b"often") == 1


def test_merges_in_any_order_of_ranks(tmp_path):
    """Where a merge makes a pair of lower rank, that one goes first."""
    with open(PATH, encoding="utf-8") as file:
        described = json.load(file)
    rnd = random.Random(2)
    described["model"]["merges"] = rnd.sample(described["model"]["merges"][:3000], 3000)
    path = tmp_path / "shuffled.json"
    path.write_text(json.dumps(described), encoding="utf-8")
    vocabulary = bpe.Vocabulary(str(path))
    words = sorted({"".join(rnd.choice(["th", "in", "e", "s", "an", "ti", "on", "a", "er"]) for _ in range(rnd.randint(1, 12)))
                    for _ in range(3000)})
    want = [[t.id for t in vocabulary.model.tokenize(w)] for w in words]
    assert bpe.merge_words([w.encode() for w in words], vocabulary) == want


def test_codec_round(spark, corpus, nothing):
    docs, rows = corpus
    encoded = bpe.encode_documents(docs, PATH)
    whole = bpe.round_trip(docs, PATH, keep_ids=True)
    got = sorted(map(tuple, whole.drop("ids").collect()), key=str)
    want = sorted(((i, len(ids_of(t)), hashlib.sha256(np.array(ids_of(t), "<u4").tobytes()).hexdigest(),
                    LIBRARY.decode(ids_of(t), skip_special_tokens=False)) for i, t in rows), key=str)
    assert got == want
    assert sorted(map(tuple, bpe.decode_documents(encoded, PATH).collect()), key=str) == sorted(
        ((w[0], w[3]) for w in want), key=str)
    assert sorted(map(tuple, encoded.collect()), key=str) == sorted(
        map(tuple, whole.select("doc_id", "ids").collect()), key=str)
    assert bpe.encode_documents(nothing, PATH).count() == bpe.round_trip(nothing, PATH).count() == 0


def test_token_files(spark, corpus, nothing):
    docs, rows = corpus
    manifest = token_files.write_token_files(docs, PATH, 1, n_files=3)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(ids_of(r[1]) + [1], "<u2").tobytes()))
    want, start = [], 0
    for i, t in ordered:
        ids = ids_of(t) + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, manifest, {3, 95}).collect()}
    assert some == {i: ids_of(dict(rows)[i]) + [1] for i in (3, 95)}
    assert token_files.read_token_files(token_files.write_token_files(nothing, PATH, 1)).count() == 0


def test_frames_stand_alone_and_are_checked(tmp_path):
    path = tmp_path / "x"
    texts = {i: np.arange(i * 7, dtype="<u2") for i in (0, 1, 5, 9)}
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, 2, frame_bytes=20)
        for i, ids in texts.items():
            writer.add(i, ids.tobytes())
        assert writer.close() == (4, 105)

    class File:
        def __init__(self, data):
            self.data, self.at = data, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at:self.at + n]

    data = path.read_bytes()
    reader = token_files.FrameReader(File(data))
    assert [(d, x.tolist()) for d, _, x in reader.documents({9})] == [(9, texts[9].tolist())]
    assert reader.frames_read == 1  # of three
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(x.tobytes() for x in texts.values())
    assert struct.unpack("<I", data[-4:])[0] == token_files.SEEK_END
    broken = bytearray(data)
    broken[int(reader._starts[1]) - 2] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(File(bytes(broken))).documents({0, 1}))


def test_a_worker_keeps_the_tables_of_one_operator_at_a_time():
    """Tables of operators that ran earlier in the worker would add up to hundreds of MB."""
    import gc
    import weakref

    from tidemart.llm import common
    table = bpe.pair_index_table(PATH)[0]
    assert bpe.pair_index_table(PATH)[0] is table
    table = weakref.ref(table)
    common.word_hashes([b"word"])
    gc.collect()
    assert table() is None
