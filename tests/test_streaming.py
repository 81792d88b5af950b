"""Drop folder: each file once, duplicates over runs, harmless repeats."""

from pyspark.sql import functions as F

from tallyfold.operators import ingest
from tallyfold.plans import fixtures
from tallyfold.sources import tables
from tallyfold.streaming import drop_folder

LAYOUT = (("Service", "service", "text"), ("Reférence", "reference", "text"), ("Montant", "montant", "number"))
HEAD = "Service,Reférence,Montant\n"


def run(spark, tmp_path, **options):
    drop_folder.stream_drop_folder(spark, str(tmp_path / "drop"), str(tmp_path / "state"), LAYOUT, **options)


def store(spark, tmp_path):
    df = spark.read.parquet(str(tmp_path / "state" / "store"))
    return sorted((r.reference, float(r.montant), r.line) for r in df.collect())


def test_two_runs(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text(HEAD + 'S,1,"1,5"\nS,2,2.0\nS,1,9\n,3,1\n')
    run(spark, tmp_path)
    assert store(spark, tmp_path) == [("1", 1.5, 2), ("2", 2.0, 3)]
    (drop / "b.csv").write_text(HEAD + "S,2,7\nS,4,8\n")
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert store(spark, tmp_path) == [("1", 1.5, 2), ("2", 2.0, 3), ("4", 8.0, 3)]
    errors = spark.read.parquet(str(tmp_path / "state" / "errors"))
    assert sorted((r.line, r.is_duplicate) for r in errors.collect()) == [(2, True), (4, True), (5, False)]
    reports = spark.read.parquet(str(tmp_path / "state" / "reports")).where("file is not null")
    assert sorted((r.rows_processed, r.rows_success, r.has_critical) for r in reports.collect()) == [(2, 1, False), (4, 2, True)]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("S", "1", "5", "f", 2), ("S", "2", "6", "f", 3)], "Service string, `Reférence` string, Montant string, file string, line long")
    folders = [str(tmp_path / "state" / n) for n in ("store", "errors", "reports")]
    for _ in range(2):
        drop_folder.load_batch(rows, 0, *folders, LAYOUT)
    assert store(spark, tmp_path) == [("1", 5.0, 2), ("2", 6.0, 3)]
    assert spark.read.parquet(folders[1]).count() == 0


def test_later_files_meet_the_store(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text(HEAD + "S,1,1\nS,2,2\n")
    run(spark, tmp_path)
    (drop / "b.csv").write_text(HEAD + "S,1,1\nS,2,2\nS,3,3\n")
    run(spark, tmp_path)
    assert [r for r, _, _ in store(spark, tmp_path)] == ["1", "2", "3"]


def test_one_run_equals_the_batch_plan(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for f in range(3):
        (drop / f"{f}.csv").write_text(HEAD + "".join(f"S,{(i * 7 + f) % 20},{i}\n" for i in range(30)))
    run(spark, tmp_path)
    raw = tables.scan_csv_numbered(spark, str(drop))
    typed = ingest.project_target_layout(raw, LAYOUT, keep=("file", "line"))
    empty = spark.createDataFrame([], "service string, reference string")
    kept = ingest.classify_import(typed, empty).where(F.col("status") == "accepted")
    assert store(spark, tmp_path) == sorted((r.reference, float(r.montant), r.line) for r in kept.collect())


def staged_batches(tmp_path):
    return sorted(p.name for p in (tmp_path / "state" / "staged").iterdir() if p.name.startswith("staged="))


def test_files_of_one_run_in_several_batches(spark, tmp_path):
    """All files wait, one file a staged batch; the second stream takes them together and keeps their order."""
    drop = tmp_path / "drop"
    drop.mkdir()
    for f in range(4):
        (drop / f"{f}.csv").write_text(HEAD + "".join(f"S,{i},{f}\n" for i in range(f, f + 3)) + ",x,1\n")
    run(spark, tmp_path, files_per_batch=1)
    assert len(staged_batches(tmp_path)) == 4
    rows = spark.read.parquet(str(tmp_path / "state" / "store")).collect()
    assert sorted(r.reference for r in rows) == [str(i) for i in range(6)]
    errors = spark.read.parquet(str(tmp_path / "state" / "errors"))
    assert errors.where("is_duplicate").count() == 6 and errors.where("not is_duplicate").count() == 4
    reports = spark.read.parquet(str(tmp_path / "state" / "reports")).where("file is not null").collect()
    assert [r.rows_processed for r in reports] == [4] * 4 and sum(r.rows_success for r in reports) == 6
    # The first batch that has a key keeps it, whichever file that was.
    seen, place = {}, {f"staged={i}": i for i in range(4)}
    staged = spark.read.parquet(str(tmp_path / "state" / "staged"))
    for r in staged.where("service is not null").orderBy("staged", "line").collect():
        seen.setdefault(r.reference, (r.file, r.line))
    assert {r.reference: (r.file, r.line) for r in rows} == seen and staged_batches(tmp_path) == list(place)


def test_a_batch_that_failed_is_replayed(spark, tmp_path, monkeypatch):
    """The job dies after the store's rows were written: the next run writes the same batch again, once."""
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text(HEAD + "S,1,1\nS,2,2\nS,1,3\n")
    run(spark, tmp_path)
    (drop / "b.csv").write_text(HEAD + "S,2,9\nS,3,4\n")

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(drop_folder, "import_report", dies)
    try:
        run(spark, tmp_path)
        raise AssertionError("must not pass")
    except Exception as e:  # noqa: BLE001 - whatever the stream wraps it in
        assert "lost" in str(e)
    monkeypatch.undo()
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert store(spark, tmp_path) == [("1", 1.0, 2), ("2", 2.0, 3), ("3", 4.0, 3)]
    assert spark.read.parquet(str(tmp_path / "state" / "errors")).count() == 2


def test_a_batch_does_not_read_the_store(spark, tmp_path):
    """Stored rows may be taken away: duplicates are known from the state alone."""
    import shutil

    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text(HEAD + "S,1,1\nS,2,2\n")
    run(spark, tmp_path)
    shutil.move(tmp_path / "state" / "store", tmp_path / "elsewhere")
    (drop / "b.csv").write_text(HEAD + "S,2,9\nS,3,4\n")
    run(spark, tmp_path)
    assert store(spark, tmp_path) == [("3", 4.0, 3)]


def test_whole_rows_are_not_joined_for_their_status(spark):
    """The statuses come from keys and places alone, so that wide rows need no shuffle."""
    names = "service string, reference string, montant string, staged long, file string, line long, kind string"
    batch = spark.createDataFrame([("S", "1", "5", 0, "f", 2, "row"), ("S", "1", "6", 0, "f", 3, "row"), ("S", "1", None, None, None, None, "first")], names)
    place = F.struct(F.lit(0).cast("long").alias("staged"), F.lit("f").alias("file"), F.lit(2).cast("long").alias("line"))
    judged = drop_folder._judge(batch.withColumn("first", F.when(F.col("kind") == "first", place)))
    assert set(judged.columns) == {"service", "reference", "staged", "file", "line", "status"}
    assert sorted((r.line, r.status) for r in judged.collect()) == [(2, ingest.ACCEPTED), (3, ingest.DUPLICATE)]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in text.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def without_broadcasts_by_size(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    return lambda: spark.conf.set(key, before)


def test_whole_rows_are_picked_by_bits(spark, tmp_path, monkeypatch):
    """Rows are picked by bitmaps of lines, over bitmap ends and in several rounds, and are not shuffled for it."""
    rows = spark.range(2, 70_003).selectExpr("concat('r', id) as reference", "if(id % 3 = 0, 'a', 'b') as file", "id as line", "id % 2 as staged")
    wanted = (F.col("line") % 7 == 0) | F.col("line").isin(2, 32767, 32768, 32769, 65536, 65537, 70_002)
    places = rows.where(wanted & (F.col("line") != 49)).select("staged", "file", "line")
    monkeypatch.setattr(drop_folder, "ROUND_BYTES", 5_000)
    drop_folder._write_at_places(rows, places, str(tmp_path / "some"))
    got = sorted((r.reference, r.file, r.line) for r in spark.read.parquet(str(tmp_path / "some")).collect())
    assert got == sorted((f"r{i}", "ba"[i % 3 == 0], i) for i in range(2, 70_003) if i != 49 and (i % 7 == 0 or i in (2, 32767, 32768, 32769, 65536, 65537, 70_002)))
    drop_folder._write_at_places(rows, places.limit(0), str(tmp_path / "some"))
    assert spark.read.parquet(str(tmp_path / "some")).columns == ["reference", "file", "line"] and spark.read.parquet(str(tmp_path / "some")).count() == 0
    bits = spark.createDataFrame([], "staged long, file string, bucket long, bits binary")
    restore = without_broadcasts_by_size(spark)
    try:
        assert exchanges(drop_folder._at_places(rows, bits)) == []
    finally:
        restore()


def test_numbering_shuffles_no_whole_rows(spark, tmp_path):
    """With the counts of splits made before, numbering needs no shuffle, whatever their size."""
    (tmp_path / "a.csv").write_text(HEAD + "S,1,1\nS,2,2\n")
    located = spark.read.option("header", True).csv(str(tmp_path)).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    starts = spark.createDataFrame(tables.split_starts(located).collect(), tables.split_starts(located).schema)
    restore = without_broadcasts_by_size(spark)
    try:
        numbered = tables.number_lines(located, starts=F.broadcast(starts))
        assert sorted((r["Reférence"], r.line) for r in numbered.collect()) == [("1", 2), ("2", 3)]
        assert exchanges(numbered) == []
    finally:
        restore()


def test_the_stream_keeps_no_whole_rows(spark, tmp_path, monkeypatch):
    """What the load persists are keys, places and bits."""
    frame = type(spark.range(0))
    seen, persist = [], frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: seen.append(set(self.columns)) or persist(self, *a))
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text(HEAD + "S,1,1\nS,2,2\nS,1,3\n")
    run(spark, tmp_path)
    assert store(spark, tmp_path) == [("1", 1.0, 2), ("2", 2.0, 3)]
    assert seen and not [x for x in seen if "montant" in x]


def test_raw_files_hold_the_raw_rows(spark, sf):
    """The drop folder's input: the rows of `raw_tx`, made behind the shuffle that orders them."""
    made, want = fixtures.raw_files(spark, sf), fixtures.frame(spark, sf, "raw_tx").drop("#", "src_row")
    assert made.columns == want.columns and made.exceptAll(want).count() == 0 and want.exceptAll(made).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Guichet") < plan.index("rangepartitioning")
