"""The Merkle manifest against a tree built from one list per language."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemart.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, top string, pos int, block int"


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)])
    return levels


def climb(levels, i, own):
    proof = []
    for nodes in levels[:-1]:
        if i ^ 1 < len(nodes):
            proof.append(nodes[i ^ 1])
            own = h(own, nodes[i ^ 1]) if i % 2 == 0 else h(nodes[i ^ 1], own)
        else:
            own = h(own)
        i //= 2
    return "".join(proof), own


def plain(docs, changed):
    by_lang = defaultdict(list)
    for row in docs:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), changed(row)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by_lang[x])]) for x in langs}
    upper, out = tree([trees[x][-1][0] for x in langs]), []
    for k, lang in enumerate(langs):
        for i, (known, doc_id, own, other) in enumerate(sorted(by_lang[lang], key=lambda r: r[:3])):
            low, at = climb(trees[lang], i, other or own)
            high, folded = climb(upper, k, at)
            out.append((doc_id if known else None, own, trees[lang][-1][0], upper[-1][0], low + high, folded))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3, 12])  # many levels of blocks, some, one
def test_manifest_equals_plain_trees(spark, levels):
    rnd = random.Random(levels)
    docs = [(i, rnd.choice(["", None, "é t", "x" * 500]), rnd.choice(["en", "en", "en", "de", "", None]),
             rnd.choice(["a", None]), rnd.choice([None, 3, 44])) for i in range(90)]
    docs += [(90 + i, "t", f"lang {i}", "s", 1) for i in range(9)] + [(4, "tie", "en", "s", 2), docs[7], docs[7],
             (None, None, None, None, None), (None, "text", "en", "s", 1), (-5, "y" * 200_000, "en", "s", 9)]
    rnd.shuffle(docs)
    frame = spark.createDataFrame([(*d, "clash", 7, 8) for d in docs], SCHEMA).repartition(5)

    def changed(row):
        doc_id, text, lang, source, n_chars = row
        return leaf(doc_id, text, lang, source, None if n_chars is None else n_chars + 1) if doc_id is not None and doc_id % 3 == 0 else None

    found = merkle.manifest(merkle.leaves(frame, {"n_chars": F.col("n_chars") + 1}, F.col("doc_id") % 3 == 0), levels).collect()
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["copied"][-1]) for r in found]
    assert sorted(got, key=str) == plain(docs, changed)
    for r in found:  # a version copies its own path and nothing else
        assert len(r["copied"]) == len(r["sides"]) + 1
        assert (r["copied"][-1] == r["root"]) == (r["changed"] in (None, r["leaf"]))


def test_nothing_gives_no_rows(spark):
    assert merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA))).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 1, 1)], SCHEMA)
    row = merkle.manifest(merkle.leaves(one)).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == leaf(1, "a", "en", "s", 1) and row["proof"] == ""


def test_text_of_the_empty_table_of_shards(spark):
    rows = spark.createDataFrame([("g", 1)], "g string, x long").where("x > 1")
    assert merkle.placed(rows, "g", ["x"]).collect() == []
