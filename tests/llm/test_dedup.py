"""Line, substring and near-duplicate removal against brute force."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemart.llm import lines, near_dups, substrings

SPACES = " \t\n\x0b\x0c\r"


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def compared(rows):
    for d, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            if len(line) >= lines.LEAST_CHARS and line.strip(SPACES):
                yield (1 << 62 if d is None else d, at), line


def lines_left(rows):
    every = list(compared(rows))
    out = []
    for d, t in rows:
        kept, me = [], 1 << 62 if d is None else d
        for at, line in enumerate((t or "").split("\n")):
            gone = len(line) >= lines.LEAST_CHARS and line.strip(SPACES) and any(
                p < (me, at) and abs(len(x) - len(line)) < 2 and distance(x, line) < 2 for p, x in every)
            if not gone:
                kept.append(line)
        out.append((d, "\n".join(kept) if t is not None else None))
    return out


def test_lines(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(18, 60))) for _ in range(20)]
    base += ["xyz" * 30 + "".join(rnd.choice("ab") for _ in range(2)) for _ in range(4)]

    def edited(x):
        for _ in range(rnd.randint(0, 3)):
            kind, i = rnd.choice("isdn"), rnd.randrange(len(x))
            if kind != "n":
                x = x[:i] + ("z" if kind != "d" else "") + (x[i:] if kind == "i" else x[i + 1:])
        return x

    rows = [(d, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(0, 5)))) for d in range(90)]
    rows += [rows[5], (None, base[0] + "\nshort"), (200, None), (201, ""), (202, "   \n" + " " * 30 + "\n")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h1 string, n_lines int")
    got = lines.dedup_lines(frame.repartition(3))
    assert got.columns == ["doc_id", "h1", "text", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(lines_left(rows), key=str)


def test_hot_line_and_near_copies_of_it(spark):
    """A third of the rows hold one line, another third one-character variants of it."""
    hot = "the same long line that everybody has " * 2
    rows = [(i, hot) for i in range(300)] + [(300 + i, hot[:i % 60] + "#" + hot[i % 60 + 1:]) for i in range(300)]
    rows += [(600 + i, f"line number {i * 7919} is its own {i * i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(0 < i < 600) for i in range(900)}


def test_short_lines(spark):
    """Lines of all lengths from one character on, also across the length where the keys begin."""
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abé c") for _ in range(n)) for n in (*range(1, 24), *range(17, 24))]
    base += ["-", "{", "});", "end", "ends", "return x"]

    def edited(x):
        kind, i = rnd.choice("isdnn"), rnd.randrange(len(x))
        return x if kind == "n" else x[:i] + ("z" if kind != "d" else "") + (x[i:] if kind == "i" else x[i + 1:])

    rows = [(d, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(0, 5)))) for d in range(60)]
    rows += [(100 + i, f"own line number {i * 7919}\n-\nend") for i in range(40)] + [(None, "end\n\n \nfresh")]
    want = lines_left(rows)
    assert want[59][1] != rows[59][1] and all(t.split("\n")[1:] == [] for _, t in want[60:100])
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_with_one_id_keep_their_own_lines(spark, doc_id):
    """Two texts of one id, or none, with equal 32-bit hashes lose nothing but repeated lines."""
    rows = [(doc_id, "row number 316485 is here\nanother line with 2506244715 of its own"),
            (doc_id, "row number 368722 is here\nthe dup line of everyone"), (1, "the dup line of everyone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r[0] for r in frame.where("doc_id IS NOT DISTINCT FROM " + ("NULL" if doc_id is None else "7"))
              .selectExpr("hash(text)").collect()}
    assert len(hashes) == 1
    got = sorted(r["text"] for r in lines.dedup_lines(frame).collect())
    assert got == sorted([rows[0][1], "row number 368722 is here", "the dup line of everyone"])


def test_lines_and_classes_keep_columns_of_any_name(spark):
    names = "row_doc string, row_tag long, row_lines int, row_gone string, n_lines string, n_removed string"
    rows = [(1, "one line\ntwo lines", "a", 2, 3, "b", "c", "d"), (2, "one line\nof its own", "e", 5, 6, "f", "g", "h")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "row_doc", "row_tag", "row_lines", "row_gone", "text", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "a", 2, 3, "b", "one line\ntwo lines", 2, 0), (2, "e", 5, 6, "f", "of its own", 2, 1)]
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    assert sorted(tuple(r) for r in stage(spark, docs, "").collect()) == [
        rows[0], (2, "of its own", *rows[1][2:])]
    names = "_id string, _digest string, digest long, class_id int, stays string, node string, _row string"
    docs = spark.createDataFrame([(i, f"text number {i % 2} " * 20, "a", "b", i, 4, "c", "d", "e") for i in range(4)],
                                 f"doc_id long, text string, {names}")
    left = near_dups.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in left.collect()) == [("a", "b", i, 4, "c", "d", "e") for i in (0, 1)]


def test_near_copies_without_an_id(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(500)}" for _ in range(200)]
    near = [*words[:100], "changed", *words[101:]]
    other = [f"v{rnd.randrange(500)}" for _ in range(200)]
    rows = [(4, " ".join(words)), (None, " ".join(near)), (None, " ".join(words)), (None, " ".join(other)),
            (None, " ".join([*other[:50], "changed", *other[51:]])), (9, "a text of its own with words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["digest"]): r["class_id"] for r in near_dups.near_classes(docs).collect()}
    assert sorted(map(str, found.values())) == ["4", "4", "4", "9", "None", "None"]
    left = near_dups.keep_one_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["4", "9", "None"]


def test_lines_of_corpus(spark, corpus, nothing):
    docs, rows = corpus
    assert lines.dedup_lines(docs).count() == len(rows)
    assert lines.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("group", [substrings.GROUP, 2])
def test_substrings(spark, corpus, nothing, group):
    docs, rows = corpus
    first = defaultdict(lambda: 1 << 62)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i:i + 50])
                first[key] = min(first[key], d)
    want = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        want.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert sum(w[2] for w in want) > 500
    got = [tuple(r) for r in substrings.remove_repeats(docs, group).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(nothing).count() == 0


def bag(text):
    w = (text or "").encode().split()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def classes(rows):
    """Connected components of weighted Jaccard similarity 0.8, by all pairs."""
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                common = sum((bags[i] & bags[j]).values())
                if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                    label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i), d) for i, (d, _) in enumerate(rows)]


def test_near_classes(spark, corpus, nothing):
    docs, rows = corpus
    got = [(r["doc_id"], r["class_id"]) for r in near_dups.near_classes(docs).collect()]
    want = [(d, c) for (d, _), c in zip(rows, classes(rows), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(d != c for d, c in want) >= 12
    left = near_dups.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in left.collect())) == sorted(
        str(d) for d, c in want if c == d)
    assert near_dups.near_classes(nothing).count() == 0


def test_near_copies_of_one_text_that_differ_among_themselves(spark):
    """A star: every copy resembles the original, few copies resemble each other."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(240)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for at in rnd.sample(range(240), 5):
            copy[at] = f"new{i}-{at}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip((d for d, _ in rows), classes(rows), strict=True))
    assert got == want and len(set(want.values())) < 60


def test_few_comparisons_among_many_copies_that_differ(spark, monkeypatch):
    """Copies with some independent edits each: near enough to share buckets, most too far to be linked."""
    compared = []
    similar = near_dups._similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_dups, "_similar", counted)
    rnd = random.Random(10)
    base = [f"w{rnd.randrange(300)}" for _ in range(120)]

    def copies(n):
        rows = []
        for i in range(n):
            copy = list(base)
            for at in sorted(rnd.sample(range(120), rnd.randint(1, 5)), reverse=True):
                copy[at:at + 1] = rnd.choice([[f"new{i}-{at}"], [], [base[at], f"more{i}-{at}"]])
            rows.append((i, " ".join(copy)))
        return rows

    for n in (100, 200):
        rows = copies(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(docs).collect()}
        assert got == dict(zip(range(n), classes(rows), strict=True))
        assert len(set(got.values())) > 0.3 * n
        assert sum(compared) < 10 * n
        compared.clear()


def test_equal_darts_are_as_likely_as_the_weighted_similarity():
    import numpy as np
    rnd = np.random.default_rng(3)
    elements = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rnd.uniform(0.1, 9, 300), rnd.uniform(0.1, 9, 300)
    b[:200] = a[:200]
    k = 4000
    s = near_dups.signatures(np.concatenate([elements, elements]), np.concatenate([a, b]),
                             np.repeat([0, 1], 300), 2, k)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
