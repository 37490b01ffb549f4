from pathlib import Path

import pytest

import corpus_pipeline
from caselens.llm.common import materialise, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = materialise(stage(spark, docs, DATA))
        assert new.columns == docs.columns, name
        assert new.join(docs, "doc_id", "left_anti").isEmpty(), name
        docs = new
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] >= 0.6 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == counts[-1]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_stages_of_no_documents(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).isEmpty(), name
