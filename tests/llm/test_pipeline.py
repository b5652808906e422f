"""The pipeline's stages and the registered queries."""

import os
import sys

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import check_queries as check  # noqa: E402

from shroudline.llm import contamination, lines, near, packing, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    line, good = check.compare(spark, check.duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert good, line


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = queries.work.settle(stage(spark, kept, SF), "stage")
        assert kept.columns == before
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert not ids & toxic
    assert near.find_near(kept).filter("not kept").count() == 0
    assert lines.drop_lines(kept.select("doc_id", "text")).filter("n_dropped > 0").count() == 0
    assert contamination.find_contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert packed.columns == packing.pack_documents(kept, queries.vocabulary("byte_bpe_50k.json")).columns
