"""Registered queries next to their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, differences
from topicweave.llm.queries import ORACLES, QUERIES
from topicweave.plans.tables import materialise

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "lines":
            lines = [tuple(sorted(set(line.lower().split()))) for text in now.values() for line in text.split("\n") if line.split()]
            assert len(lines) == len(set(lines))
            assert all(line in before[i].split("\n") for i, text in now.items() for line in text.split("\n"))
        else:
            assert all(before[i] == text for i, text in now.items())
        before = now
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r["doc_id"] for r in stage(spark, docs, SMALL).collect()} == set(before)


def test_pipeline_takes_an_empty_table(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), name)
        assert docs.isEmpty()


def test_pipeline_takes_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, docs, SMALL), name)
        assert kept.columns == docs.columns
        docs = kept
    assert not docs.isEmpty()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(rows) == docs.count()
