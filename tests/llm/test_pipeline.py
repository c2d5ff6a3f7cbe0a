"""The pipeline, its registration and every stage on odd rows."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.common import SF, edge_docs, no_docs


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [len([n for n in names if n.startswith(f"op{i}_")]) for i in range(1, 14)] == [1] * 13


def test_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0.5 * docs.count() < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    assert docs.count() < total
    packed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert packed == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_the_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("make", [edge_docs, no_docs])
@pytest.mark.parametrize("at", range(5))
def test_stage_edges(spark, make, at):
    docs = make(spark)
    out = corpus_pipeline.STAGES[at][1](spark, docs, SF)
    assert out.count() <= max(docs.count(), 1) * 3
    if at < 4:
        assert out.columns == docs.columns


def test_no_sampling_in_the_package():
    import pathlib

    import labelloom.llm as package

    for path in pathlib.Path(package.__path__[0]).glob("*.py"):
        assert not re.search(r"\.limit\(|\.sample\(|localCheckpoint|crossJoin", path.read_text()), path
