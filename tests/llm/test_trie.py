"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle_check import rows

from tidemart.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, ends string, key int"


def plain_nodes(turns, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:] if rebuild else ts
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len((p[-1][1]).encode().split()) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    out = []
    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p))
        out.append((len(p), min(ids), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    """Copies, shared beginnings, nulls, ties, repeated rows, an empty base, one long conversation."""
    rnd = random.Random(5)
    turns = []
    for c in range(-30, 260):
        if c in (40, 41):
            continue
        for t in range(rnd.choice([1, 2, 3, 5, 6])):
            turns.append((c, t, rnd.choice(["user", "bot", None]), rnd.choice(["a b", "c", "", None, "x\x0by z", "étude"])))
    for c in range(300, 420):  # one conversation many times
        turns += [(c, t, "user", f"same words {t}") for t in range(4)]
    turns += [(500, t, "user", f"turn {t} of many") for t in range(700)]
    turns += [(501, t, "user", f"turn {t} of many") for t in range(650)]
    turns += [(7, None, "user", "null turn"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "bot", "tie"),
              (None, 0, "user", "no conversation"), (None, None, None, None), (2 ** 62, 1, "", "")]
    rnd.shuffle(turns)
    return turns


def figures(nodes):
    return sorted((tuple(r) for r in nodes.drop("turn_id").collect()), key=str)


@pytest.mark.parametrize("cells", [60, 2000, trie.CELLS])  # many levels, two, one
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_plain_nodes(spark, talk, cells, rebuild):
    if rebuild and cells == 2000:
        return
    frame = spark.createDataFrame([(*t, "p", 1, "e", 2) for t in talk], SCHEMA).repartition(4)
    convs = trie.conversations(frame)
    found = trie.prefix_trie(trie.rebuilt(convs) if rebuild else convs, cells)
    assert figures(found) == plain_nodes(talk, rebuild)


def test_turn_ids_lead_to_the_texts(spark):
    turns = [(1, 0, "user", "hello"), (1, 1, "bot", "yes"), (2, 0, "user", "hello")]
    found = trie.prefix_trie(trie.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    ids = {hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32] for _, _, r, t in turns}
    assert {r["turn_id"] for r in found.where("depth > 0").collect()} == ids


def test_nothing_gives_no_nodes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(trie.prefix_trie(trie.rebuilt(trie.conversations(empty)))) == []
    only = spark.createDataFrame([(None, 1, "user", "x", "p", 1, "e", 2)], SCHEMA)
    assert rows(trie.prefix_trie(trie.conversations(only))) == []
