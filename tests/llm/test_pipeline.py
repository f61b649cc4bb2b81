"""The pipeline of operators on the smallest tables."""

import corpus_pipeline

from plumbline.llm import decontaminate, queries
from plumbline.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, held, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names, name
        assert 0.5 * held.count() <= after.count() <= held.count(), name
        held = after
    left = {r["doc_id"] for r in held.collect()}
    assert all(r["exact"] for r in held.collect())
    bad = {r["doc_id"] for r in decontaminate.find(docs, table(spark, SF, "benchmark")).collect() if r["items"]}
    # a benchmark passage that line dedup has cut out is gone already
    assert len(left & bad) <= 0.1 * max(1, len(bad)) + 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == left


def test_queries_cover_the_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_stages_take_odd_input_and_an_empty_table(spark, odd, nothing):
    for docs in (odd, nothing):
        held = materialize(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = materialize(stage(spark, held, SF))
            assert held.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
        ids = [r["doc_id"] for r in last]
        assert len(last) == held.count() and not {1, 2, 3} & set(ids)  # null, empty and blank texts go
        assert len({4, 5} & set(ids)) <= 1  # equal texts
        assert bool(ids) == (docs is odd)
