"""Every query of hookflow.llm on the smallest tables, against its SQL where it has one; the pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
from hookflow.llm import language_ppm, mixing, queries
from hookflow.llm.common import table
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, engine, name):
    df = entry_points.queries()[name](spark, SF)
    if name in queries.CHECKS:
        fine, detail = compare(engine, df, queries.CHECKS[name])
        assert fine, detail
    else:
        assert df.count() >= table(spark, SF, "documents").count()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    told = corpus_pipeline.known_language(spark, docs, SF)
    assert told.columns == docs.columns
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in language_ppm.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    cut = corpus_pipeline.without_shared_blocks(spark, docs, SF)
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] != before[r["doc_id"]]["text"])
    single = corpus_pipeline.one_of_each_group(spark, docs, SF)
    groups = queries.op3_ngram_jaccard(spark, SF).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in groups})
    mixed = corpus_pipeline.mixed_sources(spark, docs, SF)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
    assert mixed.columns == docs.columns and words == taken


def test_pipeline_runs(spark):
    out = entry_points.queries()["pipeline"](spark, SF)
    assert out.count() > 0 and out.where("offset + length > 2048").count() == 0
