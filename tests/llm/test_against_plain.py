"""The queries on the smallest tables against plain versions, and the pipeline stage by stage."""

import hashlib
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from sparkveil.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]


def test_jaccard(spark, texts):
    got = sorted(map(tuple, queries.op3_ngram_jaccard(spark, SF).collect()))
    assert got == brute.jaccard_components(texts)


def test_contamination(spark, texts):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    got = sorted(map(tuple, queries.op9_decontamination(spark, SF).collect()))
    assert got == brute.contamination(texts, items)


def test_line_dedup(spark, texts):
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute.line_dedup(texts).items()}
    assert {r.doc_id: r.text_sha256 for r in queries.op10_line_dedup(spark, SF).collect()} == want


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in queries.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in rows) / len(rows) > 0.93


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.save(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        if name == "line_dedup":
            assert after == brute.line_dedup(before)
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c in brute.jaccard_components(before) if i == c}
        if name == "benchmark_decontamination":
            assert set(after) == {r[0] for r in brute.contamination(before, items) if not r[-1]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
