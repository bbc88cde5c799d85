"""The registered queries against their SQL twins, and the pipeline."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, differences
from textlabels.llm.queries import QUERIES, SQL
from textlabels.sources.workspace import release

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), name)
        assert out.columns == columns and out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < n
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.n_tokens == len(r.ids) for r in rows)
    release(spark)
