"""Incremental load of a drop folder: every file is read once, and the first row of every key is streaming state.

Two streams follow each other. The first numbers the lines of new files and stages typed rows. The second
keeps, per key, the place (batch, file, line) at which it was first seen in a RocksDB state store, so a
batch costs what its own rows cost however many keys were loaded before; stored rows are never read again.
Whole rows are only read and written: what is shuffled or kept of them are keys, places and a bit a line.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.fixed_values import TARGET_LAYOUT
from tallyfold.operators.ingest import ACCEPTED, DUPLICATE, KEY, MISSING_KEY, classify_import, import_errors, import_report, key_present, project_target_layout
from tallyfold.operators.joins import lookup_join
from tallyfold.sources.tables import number_lines, split_starts

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit then writes what the batch changed, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_PLACE = ("staged", "file", "line")
#: Bytes of bitmaps of lines that are sent to the tasks at a time.
ROUND_BYTES = 32 << 20


def _stored_before(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """Keys stored by earlier batches. Reading only `batch < id` makes a repeated batch harmless."""
    fields = ", ".join(f"{k} string" for k in KEY)
    try:
        known = spark.read.schema(f"{fields}, batch long").parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)
    return known.where(F.col("batch") < batch_id).select(*KEY)


def _line_bits(places: DataFrame) -> DataFrame:
    """Places as bitmaps: one row per 32,768 lines of a file, cut behind the last line that is set."""
    bit = places.withColumn("bucket", F.bitmap_bucket_number("line")).withColumn("_bit", F.bitmap_bit_position("line"))
    # The lines of a bitmap meet before it is made, since one made in every task would be larger than they are.
    met = bit.repartition("staged", "file", "bucket").groupBy("staged", "file", "bucket")
    whole = met.agg(F.bitmap_construct_agg("_bit").alias("bits"), F.max("_bit").alias("_last"))
    return whole.withColumn("bits", F.substring("bits", F.lit(1), F.floor(F.col("_last") / 8).cast("int") + 1)).drop("_last")


def _at_places(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose line is set in the bitmaps; these travel to the rows, which are not shuffled."""
    found = rows.withColumn("bucket", F.bitmap_bucket_number("line")).join(F.broadcast(bits), ["staged", "file", "bucket"])
    bit = F.bitmap_bit_position("line")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(*rows.columns)


def _write_at_places(rows: DataFrame, places: DataFrame, path: str) -> None:
    """Write the rows at the places. Bitmaps go to the tasks in rounds of bounded size; one round takes some 200 million lines."""
    bits = _line_bits(places).persist()
    try:
        size = bits.agg(F.sum(F.length("bits") + F.length("file") + 100)).first()[0] or 0
        rounds = 1 + size // ROUND_BYTES
        for i in range(rounds):
            some = bits.where(F.pmod(F.xxhash64("staged", "file", "bucket"), F.lit(rounds)) == i)
            _at_places(rows, some).drop("staged").write.mode("append" if i else "overwrite").parquet(path)
    finally:
        bits.unpersist()


def _write_outcome(judged: DataFrame, batch_id: int, store: str, errors: str, reports: str, rows: DataFrame | None = None) -> None:
    """Each outcome goes to its own `batch=<id>` folder in overwrite mode, so a batch that runs again after a failure
    replaces its own output.

    With `rows`, whole rows with `staged`, `judged` need only hold keys and places: what is accepted is then picked from the rows by
    its place.
    """
    judged = judged.persist()
    accepted = judged.where(F.col("status") == ACCEPTED)
    try:
        if rows is None:
            accepted.drop("status").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        else:
            _write_at_places(rows, accepted.select(*_PLACE), f"{store}/batch={batch_id}")
        import_errors(judged).write.mode("overwrite").parquet(f"{errors}/batch={batch_id}")
        import_report(judged).write.mode("overwrite").parquet(f"{reports}/batch={batch_id}")
    finally:
        judged.unpersist()


def load_batch(rows: DataFrame, batch_id: int, store: str, errors: str, reports: str, layout=TARGET_LAYOUT) -> None:
    """Load one batch of raw rows with `file` and `line` without a stream: the keys of all earlier batches are read.

    For a single load, or to replay one; `stream_drop_folder` keeps the keys as state instead.
    """
    typed = project_target_layout(rows, layout, keep=("file", "line"))
    _write_outcome(classify_import(typed, _stored_before(rows.sparkSession, store, batch_id)), batch_id, store, errors, reports)


def _stage(spark: SparkSession, folder: str, state: str, layout, names, files_per_batch, multi_line) -> DataFrame:
    """First stream: new files as typed rows with their lines below `state/staged`; gives the schema of these rows."""
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.readStream.schema(schema).options(header=True, escape='"', multiLine=multi_line, enforceSchema=False)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    located = reader.csv(folder).select(
        *[F.col(f"`{c}`") for c in names], F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )

    def typed(batch: DataFrame, starts: DataFrame | None = None) -> DataFrame:
        return project_target_layout(number_lines(batch, starts=starts), layout, keep=("file", "line"))

    def each(batch: DataFrame, batch_id: int) -> None:
        # Numbering counts the rows of each split first: files are parsed twice, and no parsed row is kept between. The counts are made before
        # they are sent to the tasks, since Spark limits the time of a broadcast; the driver lists the splits anyway.
        starts = split_starts(batch).persist()
        try:
            starts.count()
            typed(batch, F.broadcast(starts)).write.mode("overwrite").option("compression", "zstd").parquet(f"{state}/staged/staged={batch_id}")
        finally:
            starts.unpersist()

    _run(located.writeStream.foreachBatch(each), f"{state}/staging")
    fields = ", ".join(f"`{n}` string" for n in [*names, "file"])
    return typed(spark.createDataFrame([], fields + ", _block long"))


def _run(writer, checkpoint: str):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _judge(batch: DataFrame) -> DataFrame:
    """Keys, places and statuses of a batch's rows (`kind` row) from the first places of its keys (`kind` first)."""
    rows, here = batch.where("kind = 'row'").select(*KEY, *_PLACE), key_present(KEY)
    firsts = batch.where("kind = 'first'").select(*KEY, F.col("first").alias("_first"))
    status = F.when(F.struct(*_PLACE) == F.col("_first"), ACCEPTED).otherwise(DUPLICATE)
    keyed = lookup_join(rows.where(here), firsts, KEY).withColumn("status", status).drop("_first")
    return keyed.unionByName(rows.where(~here).withColumn("status", F.lit(MISSING_KEY)))


def stream_drop_folder(spark: SparkSession, folder: str, state: str, layout=TARGET_LAYOUT, headers=None,
                       files_per_batch: int | None = None, multi_line: bool = True):
    """Load all files that are new since the last run, then stop; returns the finished query.

    Results lie below `state`: `store`, `errors`, `reports`. `headers` is the header line of the
    files in order (default: the layout's sources). The first row of a key by (run, file, line) is stored.
    """
    names = headers or [source for source, _, _ in layout]
    schema = _stage(spark, folder, state, layout, names, files_per_batch, multi_line).schema
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    schema = schema.add("staged", "long")
    staged = spark.readStream.schema(schema).parquet(f"{state}/staged").select(*KEY, *_PLACE)
    # The least place of a key never changes once an earlier batch has set it.
    firsts = staged.where(key_present(KEY)).groupBy(*KEY).agg(F.min(F.struct(*_PLACE)).alias("first"))
    both = staged.withColumn("kind", F.lit("row")).unionByName(firsts.withColumn("kind", F.lit("first")), allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            low, high = batch.agg(F.min("staged"), F.max("staged")).first()
            rows = spark.read.schema(schema).parquet(f"{state}/staged").where(F.col("staged").between(low, high))
            _write_outcome(_judge(batch), batch_id, f"{state}/store", f"{state}/errors", f"{state}/reports", rows)
        finally:
            batch.unpersist()

    return _run(both.writeStream.outputMode("update").foreachBatch(each), f"{state}/checkpoint")
