"""The stages over a small corpus, each against what it must do."""

from collections import Counter

import corpus_pipeline
import pytest

from starmodel.llm import registry

from .test_simhash import brute_near

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        after = out.collect()
        if name == "quality":
            kept = {r.doc_id for r in after}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
            assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * max(1, sum(q == 0 for q in labels.values()))
            assert all(before[r.doc_id] == r for r in after)
        elif name == "lines":
            assert {r.doc_id for r in after} == set(before)
            n = Counter(k for r in before.values() for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n")} if k)
            assert all(n[x.strip().lower()] < 10 for r in after for x in r.text.split("\n") if x.isascii())
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_copies":
            rows = sorted((r.doc_id, r.text) for r in before.values())
            roots = brute_near(rows)
            assert sorted(r.doc_id for r in after) == [rows[i][0] for i in sorted(set(roots))]
        else:
            assert {r.doc_id for r in after} == set(before)
            return
        assert out.columns == columns
        before = {r.doc_id: r for r in after}
        docs = spark.createDataFrame(after, docs.schema)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
