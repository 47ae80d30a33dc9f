"""Repetition rules, benchmark matches and the toxicity chain."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import decontamination, repetition, toxicity
from tidemart.llm.common import word_hashes


def measured(text, limits):
    words = (text or "").encode().split()
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = set()
    for i in range(n):
        if best[i] >= limits.least_repeat:
            covered |= set(range(i, i + best[i]))
    windows = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    repeats = set()
    for i in range(n - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeats |= {i, i + 1, i + 2}
    longest = max([b for b in best if b >= limits.least_repeat], default=0)
    failed = n < 50 or 100 * len(repeats) > 50 * n
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeats),
            failed, not failed and len(covered) <= limits.most_covered * n and longest <= limits.longest_repeat,
            longest, len(covered))


def test_repetition(spark, corpus, nothing):
    rnd = random.Random(3)
    limits = repetition.Limits(least_repeat=4, most_covered=0.3, longest_repeat=12)
    words = ["a", "b", "c", "d#", "ée", "|"]
    rows = [(i, " ".join(rnd.choice(words[:rnd.randint(1, 6)]) + rnd.choice(["", "\n"]) for _ in range(rnd.randint(0, 90))))
            for i in range(60)]
    rows += [r for r in corpus[1] if len(r[1] or "") < 2000]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    got = repetition.quality_rules(frame, limits).collect()
    have = sorted(((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                                  r["base_failed"], r["kept"], r["longest_repeat"], r["covered_words"]))
                   for r in got), key=str)
    assert have == sorted(((d, measured(t, limits)) for d, t in rows), key=str)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["covered_words"] for r in got)
    assert repetition.quality_rules(nothing).count() == 0


def nearest(item, passage):
    before = [0] * (len(passage) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(passage, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return min(before)


def test_myers_equals_the_table():
    rnd = random.Random(2)
    for _ in range(300):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 70))]
        passage = [rnd.randrange(4) for _ in range(rnd.randint(0, 90))]
        assert decontamination.myers(item, passage)[0] == nearest(item, passage)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_benchmark_matches(spark, nothing, block_bytes):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 45)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "..."), (33, "Übung macht den Meister, jeden Tag wieder neu!"), items[0]]
    docs = []
    for d in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        part = rnd.choice(items[:25])[1].split()
        for _ in range(rnd.randint(0, 7)):
            i, kind = rnd.randrange(len(part)) if part else 0, rnd.choice("isd")
            part = part[:i] + ([rnd.choice(words)] if kind != "d" else []) + (part[i:] if kind == "i" else part[i + 1:])
        at = rnd.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + [x.upper() + "," for x in part] + text[at:])))
    docs += [(200, None), (201, ""), (202, "ÜBUNG macht den Meister\njeden Tag wieder neu"), docs[3]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, found string").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    found = decontamination.match_benchmark(frame.drop("found"), bench, block_bytes=block_bytes)
    got = sorted((r["doc_id"], sorted((m["item_id"], m["distance"]) for m in r["found"])) for r in found.collect())
    want = []
    for d, t in docs:
        own, hits = decontamination.words_of((t or "").encode()), set()
        for i, x in items:
            item = decontamination.words_of((x or "").encode())
            if item:
                k = nearest(word_hashes(item).tolist(), word_hashes(own).tolist())
                if k <= decontamination.budget(len(item)):
                    hits.add((i, k))
        want.append((d, sorted(hits)))
    assert got == sorted(want)
    clashing = frame.selectExpr("doc_id", "text", "doc_id AS row", "found AS digest", "1 AS _row")
    found = decontamination.match_benchmark(clashing, bench, block_bytes=block_bytes)
    assert found.columns == [*clashing.columns, "found"] and found.count() == len(docs)
    assert found.where("row IS DISTINCT FROM doc_id OR digest <> 'x' OR _row <> 1").count() == 0
    clean = decontamination.decontaminate(frame, bench, block_bytes=block_bytes)
    assert clean.columns == ["doc_id", "text", "found"]
    assert {r["found"] for r in clean.collect()} == {"x"}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, h in want if not h)
    assert decontamination.decontaminate(nothing, bench).count() == 0
    none = bench.limit(0)
    assert decontamination.decontaminate(frame, none).count() == len(docs)


def test_toxicity_held_out(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    chain = toxicity.train(docs, labels.where(~held))
    assert chain.categories == ("quality", "toxic")
    assert [len(m) - len(c) for m, c in zip(chain.models, chain.columns, strict=True)] == [1, 2]
    scored = toxicity.score(docs, chain).join(
        labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    counts = {(r["label"], r["toxic"]): r["count"] for r in scored.groupBy("label", "toxic").count().collect()}
    right, missed, wrong = counts[1, True], counts.get((1, False), 0), counts.get((0, True), 0)
    # one label in sixteen of the toxic ones sits on junk without any such word
    assert right >= 0.9 * (right + missed) and wrong <= 0.005 * counts[0, False]


def slow_logistic(x, y, penalty, share):
    """Penalized maximum likelihood by accelerated gradient steps, row by row weights, intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each, ridge = share / share.mean(), np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    step = 1 / (0.25 * np.linalg.eigvalsh((x * each[:, None]).T @ x)[-1] + penalty)
    w = ahead = np.zeros(x.shape[1])
    for i in range(60_000):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        new = ahead - step * (x.T @ (each * (p - y)) + ridge * ahead)
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


def test_toxicity_fit_equals_a_plain_one():
    rng = np.random.default_rng(3)
    x = rng.poisson(0.6, (150, 4)).astype(float)
    folds, share = rng.integers(0, 3, 150), rng.choice([1.0, 4.0], 150)
    first = (x[:, 0] + rng.normal(0, 1, 150) > 0.7).astype(float)
    last = ((first + x[:, 1] + rng.normal(0, 1, 150)) > 1.5).astype(float)
    first[::9] = -1  # unknown
    got = toxicity.fit_chain(x, [first, last], folds, 0.5, share)
    known = first >= 0
    out_of_fold = np.zeros(150)
    for fold in range(3):
        learn = [i for i in range(150) if folds[i] != fold and known[i]]
        w = slow_logistic(x[learn], first[learn], 0.5, share[learn])
        for i in range(150):
            if folds[i] == fold:
                out_of_fold[i] = 1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1])))
    want = [slow_logistic(x[known], first[known], 0.5, share[known]),
            slow_logistic(np.hstack([x, out_of_fold[:, None]]), last, 0.5, share)]
    for a, b in zip(got, want, strict=True):
        assert np.abs(a - b).max() < 1e-3
    # scores take the first model's own probability where the fit took the one out of its fold
    p = toxicity.chain_probabilities(x, got)
    own = 1 / (1 + np.exp(-(x @ want[0][:-1] + want[0][-1])))
    both = 1 / (1 + np.exp(-(np.hstack([x, own[:, None]]) @ want[1][:-1] + want[1][-1])))
    assert np.abs(p[:, 0] - own).max() < 1e-3 and np.abs(p[:, 1] - both).max() < 1e-3


def test_toxicity_train_holds_little_in_the_driver(spark):
    """The fit makes no copies of the sample's features: some 2,000 texts and 576 features are 9 MB as doubles."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(700)]
    rows = [(i, " ".join(rng.choices(words[:600] if i % 2 else words[100:], k=40)), i % 3 % 2, i % 2) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    chain = toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chain.features) >= 512
    assert peak < 25e6


def test_toxicity_fit_by_places_in_values_and_in_blocks():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.7, (2500, 6)).astype(np.uint32) * rng.choice([1, 70_000], (2500, 6)).astype(np.uint32)
    rows = [(np.flatnonzero(c).astype(np.uint32).tobytes(), c[c > 0].tobytes()) for c in counts]
    x, values = toxicity._places_in_values(rows, 6)
    assert x.itemsize == 1 and (values[x] == counts).all()
    y = (np.log1p(counts[:, 0]) + rng.normal(0, 2, 2500) > 1).astype(float)
    folds, share = rng.integers(0, 4, 2500), rng.choice([1.0, 3.0], 2500)
    got = toxicity.fit_chain(x, [y], folds, 0.5, share, [[0, 2, 5]], np.log1p(values))
    want = slow_logistic(np.log1p(counts[:, [0, 2, 5]].astype(float)), y, 0.5, share)
    assert np.abs(got[0] - want).max() < 1e-3


def test_toxicity_of_a_sample_keeps_the_odds_of_the_labels(spark):
    """Both classes are cut to 250 labels; the clean ones are eight times as many."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    settings = toxicity.Settings(sample_rows=500)
    known = {r["toxic"]: r["count"] for r in labels.where(~held).groupBy("toxic").count().collect()}
    assert min(known.values()) > 250
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held), settings), settings).join(
        labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    clean, bad = scored.groupBy("label").agg(
        F.avg(F.col("toxic").cast("int")).alias("rejected"), F.avg("p_toxic").alias("p")).orderBy("label").collect()
    assert clean["rejected"] <= 0.01 and clean["p"] <= 0.03 and bad["rejected"] >= 0.9


def test_toxicity_sample_of_an_id_with_many_rows(spark):
    rows = [(i, f"text {i}") for i in range(20)] + [(7, f"text 7 row {i}") for i in range(300)] + [(3, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["text"] for r in toxicity._sample(docs, labels, toxicity.Settings(sample_rows=16)).collect())
    assert len(got) == 16 and set(got) <= {f"text {i}" for i in range(20)}


def test_toxicity_cases(spark, corpus, nothing):
    docs, rows = corpus
    docs = docs.withColumns({"toxic": F.lit(5), "p_toxic": F.lit(7)})
    labels = spark.createDataFrame([(i, int(i in range(80, 90))) for i in range(100)] + [(None, 1), (3, None), (9999, 1)],
                                   "doc_id long, toxic int")
    settings = toxicity.Settings(least_texts=2)
    left = toxicity.drop_toxic(docs, labels, settings)
    assert left.columns == docs.columns
    kept = left.collect()
    assert {(r["toxic"], r["found"], r["p_toxic"]) for r in kept} == {(5, "y", 7)}
    ids = {r["doc_id"] for r in kept}
    assert not ids & set(range(80, 90)) and len(ids) > 80
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        assert toxicity.drop_toxic(docs, few).count() == len(rows)
    assert toxicity.drop_toxic(nothing, labels, settings).count() == 0
