"""The corpus pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= set(before) and ids, name
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert len({brute.lower(before[i]) for i in ids}) == len(ids)
        if k == 2:
            bad = {r[0] for r in brute.contamination(before.items(), items) if r[5]}
            assert set(ids) == set(before) - bad
        seen.append(len(ids))
    assert seen[3] == seen[4]
    assert corpus_pipeline.run(spark, SF).count() == seen[4]
