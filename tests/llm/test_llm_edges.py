"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from frames import SHORT, documents, labels
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm.credentials import scan_secrets
from tallyfold.llm.decontaminate import contamination
from tallyfold.llm.langid import identify_languages
from tallyfold.llm.linededup import dedup_lines
from tallyfold.llm.neardup import near_duplicates
from tallyfold.llm.packing import pack_sequences
from tallyfold.llm.quality import quality_scores
from tallyfold.llm.topk import top_k
from tallyfold.llm.toxicity import toxicity_scores
from tallyfold.llm.warc import archive_round_trip

LABELS = [(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 1), (7, 0, 0), (99, 1, 1)]


def by_id(df, *columns):
    return sorted([tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()], key=repr)


def test_secrets(spark):
    out = {r.doc_id: r for r in scan_secrets(documents(spark)).where("doc_id is not null or n_assign > 0").collect()}
    assert out[None].n_assign == 1 and out[None].spans.startswith("assign:27:")
    assert out[2].spans == "" and out[2].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert scan_secrets(documents(spark)).count() == len(SHORT)
    assert scan_secrets(documents(spark, [])).count() == 0


def test_near_duplicates(spark):
    out = by_id(near_duplicates(documents(spark), words=2), "n_shingles", "component_id", "kept")
    assert (2, 0, 2, True) in out and (4, 0, 4, True) in out and (None, 0, None, True) in out and (7, 1, 7, True) in out
    assert [r for r in out if r[0] == 1] == [(1, 19, 1, True)] * 2
    assert [r for r in out if r[0] == 10] == [(10, 19, 1, False)]
    assert len(out) == len(SHORT)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "sat on the mat"), (2, None), (3, ""), (None, "looked at"), (4, "sat on the mat"), (5, "nowhere to be found")], "item_id long, text string").withColumn("key", F.lit("own"))
    out = by_id(contamination(documents(spark), items), "n_words", "n_hit", "n_items", "contaminated")
    assert [r for r in out if r[0] in (1, 10)] == [(1, 20, 4, 2, True)] * 2 + [(10, 20, 4, 2, True)] and len(out) == len(SHORT)
    assert (2, 0, 0, 0, False) in out and (3, 0, 0, 0, False) in out
    assert contamination(documents(spark), items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert contamination(documents(spark, []), items).count() == 0


def test_line_dedup(spark):
    docs = documents(spark)
    out = dedup_lines(docs)
    assert set(out.columns) == set(docs.columns)  # its two results replace columns of their names
    got = by_id(out, "text", "n_lines", "n_dropped")
    assert [r for r in got if r[0] == 1] == [(1, SHORT[0][1], 2, 0)] * 2  # rows that repeat an id and text are one document
    assert (10, "", 2, 2) in got and (2, None, 0, 0) in got and (3, "", 1, 0) in got and len(got) == len(SHORT)
    assert dedup_lines(documents(spark, [])).count() == 0


def test_languages(spark):
    out = by_id(identify_languages(documents(spark)), "lang_pred")
    assert (2, "und") in out and (5, "und") in out and (3, "und") in out and len(out) == len(SHORT)
    assert all(x != "und" for i, x in out if i in (1, 6, 8))
    bare = identify_languages(documents(spark, [(1, "abc", None)]))
    assert by_id(bare, "lang_pred", "score") == [(1, "und", 0.0)]
    assert identify_languages(documents(spark, [])).count() == 0


def test_packing(spark):
    path = corpus_pipeline.TOKENIZER
    out = pack_sequences(documents(spark), path)
    assert out.where("doc_tokens = 1").count() >= 4  # null and empty texts are the closing id alone
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("doc_id = 6 and n <> m").count() == 0
    assert pack_sequences(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("scores,label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_scores(spark, scores, label):
    out = by_id(scores(documents(spark), labels(spark, LABELS)), "score", "predicted")
    assert len(out) == len(SHORT) and all(0 <= r[1] <= 1 and r[2] in (0, 1) for r in out)
    none = by_id(scores(documents(spark), labels(spark, [])), "score")
    assert {r[1] for r in none} == {0.5}
    assert scores(documents(spark, []), labels(spark, LABELS)).count() == 0


def test_topk(spark):
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (1, [0.3]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, []), (None, [1.0, 1.0]), (50, [1e30, 1e30]), (6, [-0.1, 0.4]), (7, [float("inf"), 0.0])]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("place", F.lit("own")))
    got = sorted(tuple(r) for r in out.collect())
    assert {r[0] for r in got} == {0, 50} and {r[2] for r in got} <= {0, 1, 5, 50, 6}
    assert [r for r in got if r[0] == 0 and r[1] == 1] == [(0, 1, 50, got[0][3])] * 2
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/ä b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "x\r\ny: z", "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit("own"))
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_round_trip(pages).collect()], key=repr)
    assert got == sorted([(1, 9, "revisit", 2), (2, 9, "response", None), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 9, "revisit", 2), (5, 500_000, "response", None)], key=repr)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = documents(spark)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == rows.columns, name
    kept = by_id(corpus_pipeline.near_stage(spark, docs, sf), "lang")
    assert len([r for r in kept if r[0] == 1]) == 1 and len([r for r in kept if r[0] is None]) == 2 and (2, "en") in kept
    lines = by_id(corpus_pipeline.line_stage(spark, docs, sf), "n_chars")
    assert 10 not in {r[0] for r in lines} and {2, 3, 4} <= {r[0] for r in lines}
