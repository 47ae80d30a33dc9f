"""The compression classifier: held-out labels, the plain definition, and odd tables."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemart.llm import compression, queries
from tidemart.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    found = queries.QUERIES["op11_quality_compression"](spark, SF)
    labels = table(spark, SF, "labels", "doc_id", "quality")
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == table(spark, SF, "documents", "doc_id").count()
    return rows


def test_held_out_labels(scored):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    known = [r for r in scored if r["held_out"] and r["quality"] is not None]
    y = np.array([r["quality"] for r in known])
    p = np.array([r["score"] for r in known])
    above = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert above > 0.97
    said = np.array([r["predicted"] for r in known])
    assert (said == (p >= 0.3)).all() and (said == y).mean() > 0.93
    # calibrated: the mean score is near the share of good texts, overall and for either half of the scores
    assert abs(p.mean() - y.mean()) < 0.04
    upper = p >= np.median(p)
    assert abs(p[upper].mean() - y[upper].mean()) < 0.06 and abs(p[~upper].mean() - y[~upper].mean()) < 0.06


def test_score_follows_its_definition(spark):
    """Sizes by the library, chunk by chunk, and the curve by plain gradient steps."""
    settings = compression.Settings(chunk=64, dictionary=2000)
    good = [f"the river runs {i} miles to the sea and the boats follow" for i in range(200)]
    bad = [f"BUY {i} NOW!! $$$ | cheap | cheap | offer {i * 7} %%%" for i in range(200)]
    own = tuple(compression.build_dictionary([t.encode() for t in x], 2000) for x in (bad, good))
    model = compression.Model(own, 3.0, 0.5)
    docs = [(i, t) for i, t in enumerate([*good[:3], *bad[:3], "", None, "é" * 1000])]
    frame = spark.createDataFrame([(i, t, 9.0, "x") for i, t in docs], "doc_id long, text string, score double, predicted string")
    found = {r["doc_id"]: r for r in compression.score(frame, model, settings).collect()}
    for i, text in docs:
        data, sums = (text or "").encode(), []
        for d in own:
            c = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                         write_checksum=False, write_dict_id=False)
            sums.append(sum(len(c.compress(data[a:a + 64])) for a in range(0, len(data), 64)))
        x = (sums[0] - sums[1]) / sum(sums) if data else 0.0
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-(3 * x + 0.5))), abs=1e-9)
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.3)

    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(-1, 1, 60), rnd.normal(1, 1, 90)])
    y, weight = np.repeat([0.0, 1.0], [60, 90]), np.repeat([3.0, 1.0], [60, 90])
    slope, intercept = compression.fit_curve(x, y, weight)
    w, scale, each = np.zeros(2), x.std(), weight / weight.mean()
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(w[0] * x / scale + w[1])))
        w -= 0.005 * np.array([(each * (p - y) * x / scale).sum() + w[0], (each * (p - y)).sum()])
    assert (slope, intercept) == pytest.approx((w[0] / scale, w[1]), abs=1e-3)


def test_cut_class_keeps_its_share(spark):
    """With a sample of equal classes, scores still follow the share of each in all labels."""
    rows = [(i, f"good words number {i} here and more of them {i % 7}" if i % 10 else f"## {i} !! $$$ {i} ||| %%") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0 or i % 40 == 0)) for i, _ in rows], "doc_id long, quality int")
    model = compression.train(docs, labels, compression.Settings(sample_rows=80))
    p = compression.score(docs, model).select("score").toPandas()["score"]
    assert abs(p.mean() - 0.925) < 0.05


def test_odd_tables(spark, corpus, nothing):
    frame, rows = corpus
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(None, 1), (3, None), (5, 1), (5, 0)],
                                   "doc_id long, quality int")
    model = compression.train(frame, labels)
    found = compression.score(frame.withColumn("predicted", F.lit("old")), model)
    assert found.columns == [*frame.columns, "score", "predicted"] and found.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert compression.score(nothing, model).count() == 0
    for known in (labels.where("quality = 1"), labels.limit(0)):
        same = compression.score(frame, compression.train(frame, known)).select("score").distinct().collect()
        assert len(same) == 1
    assert compression.train(nothing, labels).dictionaries is None
