"""CSV in splits against the reader that streams each file."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.sources import split_csv, tables


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fields(chance):
    kind = chance.randrange(9)
    if kind == 0:
        return '"two\nlines, ""and"" quotes"'
    if kind == 1:
        return '"' + "\n".join("long, part" * chance.randrange(1, 8) for _ in range(chance.randrange(1, 30))) + '"'
    if kind == 2:
        return 'in"ner'
    return chance.choice(["", "x", '"q"', '"a,b"', '""', "é ü", '"""start"', '"\n"', "5"])


def bag(df, names):
    return sorted(df.select(*names).collect(), key=repr)


@pytest.mark.parametrize("seed,newline", [(1, "\n"), (2, "\r\n")])
def test_equals_the_streaming_reader(spark, tmp_path, small_splits, seed, newline):
    chance = random.Random(seed)
    for f in range(3):
        body = "".join(",".join(fields(chance) for _ in range(3)) + ("\n" if chance.random() < 0.98 else "\n\n") for _ in range(120))
        (tmp_path / f"{f}.csv").write_bytes(("a,b c,d\n" + body).replace("\n", newline).encode())
    got = split_csv.scan_split_csv(spark, str(tmp_path))
    want = tables.scan_csv_numbered(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    a, b = bag(got, ["a", "`b c`", "d", "file", "line"]), bag(want, ["a", "`b c`", "d", "file", "line"])
    assert len(a) == len(b) > 300
    assert [r for r in a if r not in b][:3] == [r for r in b if r not in a][:3] == []


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, with comma" for i in range(2000))
    (tmp_path / "x.csv").write_text(f'k,v\n1,"{long}"\n2,b\n3,"{long}"\n4,last')
    rows = split_csv.scan_split_csv(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.k, r.v, r.line) for r in rows] == [("1", long, 2), ("2", "b", 3), ("3", long, 4), ("4", "last", 5)]


def test_headers_and_wanted_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    out = split_csv.scan_split_csv(spark, str(tmp_path), wanted=["b", "z"]).collect()
    assert [(r.b, r.z, r.line) for r in out] == [("2", None, 2)]
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        split_csv.scan_split_csv(spark, str(tmp_path), columns=["a", "b"]).collect()
    (tmp_path / "b.csv").write_text("a,b\n")
    assert split_csv.scan_split_csv(spark, str(tmp_path)).where(F.col("file").contains("b.csv")).count() == 0


def test_numbers_go_on_through_part_files(spark, tmp_path, small_splits):
    for folder, parts in {"a": [["1", '"2\nb"'], ["3"], ["4", "5"]], "b": [["6"]]}.items():
        (tmp_path / f"folder={folder}").mkdir()
        for i, values in enumerate(parts):
            (tmp_path / f"folder={folder}" / f"part-{i}.csv").write_text("\n".join(["x,y", *[f"{v},{folder}" for v in values]]) + "\n")
    rows = split_csv.scan_split_csv(spark, f"{tmp_path}/*")
    got = split_csv.number_on(rows, "y").select("x", "y", "line").collect()
    assert sorted(map(tuple, got)) == [("1", "a", 2), ("2\nb", "a", 3), ("3", "a", 4), ("4", "a", 5), ("5", "a", 6), ("6", "b", 2)]


def test_query_writes_a_language_in_more_than_one_task(spark, tmp_path):
    from tallyfold.plans import ingest_queries

    docs = spark.range(400).selectExpr("id as doc_id", "'en' as lang", "repeat('x', 10) as text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    plan = ingest_queries.scan_split_csv(spark, str(tmp_path))
    spark.conf.set(coalesce, before)
    assert len(plan.inputFiles()) > 1
    assert sorted((int(r.doc_id), r.line) for r in plan.collect()) == [(i, i + 2) for i in range(400)]
