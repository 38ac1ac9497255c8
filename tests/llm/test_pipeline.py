"""The pipeline and its queries on the smallest tables."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from paperlake.llm import catalog
from paperlake.llm.shared import store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert docs.where("text rlike '@mail[0-9]'").count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f.__name__ for f in catalog.QUERIES} | {"pipeline"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names
