"""The pipeline on small data: stages, columns, and the shape of the registry."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from demandlake.llm import catalog
from tests.llm.cases import odd_rows, prose

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_registry():
    names = set(entry.queries())
    assert set(catalog.QUERIES) | {"pipeline"} <= names and set(catalog.SQL) <= set(catalog.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_stages_one_by_one(spark, tmp_path):
    item = prose(30, 777)
    rows = [(i, prose(90, i), "en", "s", 1) for i in range(30)]
    rows += [(100, prose(90, 3), "en", "s", 1), (101, prose(90, 50) + " " + item, "en", "s", 1),
             (102, prose(90, 51) + " password=abcdef0123456789", "en", "s", 1)]
    rows += [(r[0] if r[0] is None else 1000 + r[0], *r[1:5]) for r in odd_rows()]  # ids of their own
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out.cache()
        seen[name] = {r.doc_id for r in docs.collect()}
    assert set(range(30)) | {100, 101, 102} <= seen["quality_rules"] and not seen["quality_rules"] & {1001, 1002, 1003, 1008, 1009}
    assert 100 not in seen["near_dedup"] and 3 in seen["near_dedup"]
    assert seen["near_dedup"] - seen["decontamination"] == {101}
    assert seen["secret_scan"] == seen["decontamination"] == seen["sentencepiece"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == seen["sentencepiece"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_queries_keep_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_simhash_near_dedup", "op3_quality_rules", "op5_token_dac", "op6_sentencepiece_nbest", "op7_toxicity_mil",
                 "op8_secret_scan"):
        assert catalog.QUERIES[name](spark, SF).count() == n, name
