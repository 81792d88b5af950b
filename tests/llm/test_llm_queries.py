"""Registered queries of the training-data operators: against SQL, and what they promise of their rows."""

import compare
import pytest

import __spark_entry__ as entry
from tallyfold.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("key", sorted(LLM_ORACLES))
def test_query_matches_sql(key, spark, con, sf):
    assert compare.difference(compare.spark_bag(LLM_QUERIES[key](spark, sf)), compare.duck_bag(con, LLM_ORACLES[key])) is None


@pytest.mark.parametrize("key", ["op2_secrets", "op6_langid", "op9_toxicity", "op10_quality"])
def test_one_row_per_document(key, spark, sf):
    out = LLM_QUERIES[key](spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    if "score" in out.columns:
        assert out.where("score is null or score < 0 or score > 1").count() == 0


def test_all_are_registered():
    numbers = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("key,label", [("op9_toxicity", "toxic"), ("op10_quality", "quality")])
def test_held_out_accuracy(key, label, spark):
    sf = "/root/testdata/sf0.01"
    marked = LLM_QUERIES[key](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(f"held_out and {label} is not null")
    right, total = marked.where(f"predicted = {label}").count(), marked.count()
    assert total > 50 and right >= 0.9 * total


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    marked = LLM_QUERIES["op6_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert marked.where("lang = lang_pred").count() >= 0.97 * marked.count() > 100
