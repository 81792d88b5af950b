"""Bucketed store: right answers, no exchange on the store's side, only the buckets that are hit."""

import re

from pyspark.sql import functions as F

from tallyfold.operators import ingest
from tallyfold.sources import key_store

SCHEMA = "service string, reference string, montant int, file string, line long"


def rows(spark, refs, file="f", service="S"):
    return spark.createDataFrame([(service, r, i, file, i) for i, r in enumerate(refs)], SCHEMA)


def files_read(df):
    """Rows, and the files that the scans of the finished plan opened, by the table's folder (metrics count one run only)."""
    rows, out = df.collect(), {}
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            place = re.search(r"Location: .*?/(rows|filters)\b", node.verboseStringWithOperatorId().replace("\n", " "))
            out[place.group(1) if place else "other"] = node.metrics().apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return rows, out


def test_append_absent_over_several_deliveries(spark, tmp_path):
    store = key_store.create_store(spark, str(tmp_path / "s"), SCHEMA, buckets=8, blocks=2)
    a = store.append_absent(rows(spark, ["1", "2", "1", None, ""]))
    assert sorted((r.line, r.status) for r in a.collect()) == [(0, "accepted"), (1, "accepted"), (2, "duplicate"), (3, "missing_key"), (4, "missing_key")]
    again = key_store.open_store(spark, str(tmp_path / "s"))
    b = again.append_absent(rows(spark, ["2", "3", "3", "1", "4"], "g"))
    assert sorted((r.line, r.status) for r in b.collect()) == [(0, "duplicate"), (1, "accepted"), (2, "duplicate"), (3, "duplicate"), (4, "accepted")]
    assert sorted((r.reference, r.file) for r in again.rows().collect()) == [("1", "f"), ("2", "f"), ("3", "g"), ("4", "g")]
    assert again.matching(rows(spark, [])).count() == 0
    assert {r.status for r in again.classify(rows(spark, ["4", "9"]), dry_run=True).collect()} == {"accepted", "duplicate"}


def test_a_load_equals_the_plain_operator(spark, tmp_path):
    store = key_store.create_store(spark, str(tmp_path / "s"), SCHEMA, buckets=16, blocks=1)
    stored = spark.range(5000).select(F.lit("S").alias("service"), (F.col("id") * 3).cast("string").alias("reference"), F.lit(1).alias("montant"), F.lit("f").alias("file"), F.col("id").alias("line"))
    store.append(stored)
    incoming = spark.range(9000).select(F.when(F.col("id") % 50 != 0, "S").alias("service"), (F.col("id") % 7000).cast("string").alias("reference"), F.lit(1).alias("montant"), F.lit("g").alias("file"), F.col("id").alias("line"))
    want = ingest.classify_import(incoming, stored)
    got = store.classify(incoming)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_only_hit_buckets_are_read_and_the_store_is_not_shuffled(spark, tmp_path):
    store = key_store.create_store(spark, str(tmp_path / "s"), SCHEMA, buckets=32, blocks=4)
    store.append(rows(spark, [f"R{i}" for i in range(4000)]))
    assert len({f for f in (tmp_path / "s" / "rows").iterdir() if f.name.startswith("part")}) == 32
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = store.matching(rows(spark, ["R7", "R8", "new"]))
        got, files = files_read(found)
        assert {r.reference for r in got} == {"R7", "R8"} and 1 <= files["rows"] <= 2
        text = found._jdf.queryExecution().executedPlan().toString()
        final = text[:text.index("Initial Plan")]
        assert "Bucketed: true" in final and final.count("Exchange hashpartitioning") == 1  # the delivery's
        # Keys that were never stored are stopped by the filters, and no bucket is opened.
        absent = store.matching(rows(spark, [f"N{i}" for i in range(50)]))
        got, files = files_read(absent)
        assert got == [] and files.get("rows", 0) <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
