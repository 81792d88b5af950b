"""Reading the given tables, and tables written on the way."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyfold.session import apply_plan_settings, new_table_path


#: Rows and bytes that go to a Python worker at a time, so that long texts do not fill its memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return apply_plan_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and nothing above is computed twice."""
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Smaller Arrow batches for the tables stored inside, where workers hold tables of their own besides their rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
