"""Registered queries: DuckDB where SQL can say it, and the pipeline stage by stage."""

import pytest
from oracle_check import connect, oracle_rows, spark_rows

import corpus_pipeline
from tidemart.llm import decontamination, queries
from tidemart.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(name.split("_")[0] for name in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, SF))
    assert got == oracle_rows(connect(SF), queries.ORACLE[name]) and got[1]


def test_stages(spark, corpus, nothing):
    from test_dedup import classes, lines_left
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "encode":
            assert docs.columns == before.columns
    before, after = kept["line_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = [(d, t) for (d, t), (_, old) in zip(lines_left(rows), rows, strict=True) if t.strip() or t == old]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == want
    assert after.where("n_chars <> char_length(text)").isEmpty()
    before, after = kept["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert sorted(r["doc_id"] for r in after.collect()) == [
        d for (d, _), c in zip(rows, classes(rows), strict=True) if d == c]
    before, after = kept["decontamination"]
    items = [decontamination.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in before.collect() if any(
        b" ".join(i) in b" ".join(decontamination.words_of(r["text"].encode())) for i in items)}
    left = {r["doc_id"] for r in after.collect()}
    assert held and not held & left and len(left) >= before.count() - len(held) - 2
    assert kept["encode"][1].count() == len(left)


def test_stages_on_odd_rows(spark, corpus, nothing):
    for docs in (corpus[0], nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()
