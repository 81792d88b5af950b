"""Delimited files and database tables as DataFrames."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CSV = {"header": True, "escape": '"', "encoding": "UTF-8", "enforceSchema": False, "mode": "PERMISSIVE"}
FILE_COLUMN, LINE_COLUMN = "file", "line"


def scan_csv_text(spark: SparkSession, path, wanted=None, sep: str = ",", multi_line: bool = True, **options) -> DataFrame:
    """Header CSV with every column as text; `wanted` columns that the files lack come out null.

    `path` is a path or a list of paths whose files share one header: a file with another header
    fails instead of shifting columns. Quoted line breaks need `multi_line`, which streams each file
    through one task; where `has_quoted_breaks` says there are none, switch it off and large files are split.
    """
    df = spark.read.options(**_CSV, sep=sep, multiLine=multi_line, inferSchema=False, **options).csv(path)
    return with_columns_present(df, wanted) if wanted else df


def has_quoted_breaks(spark: SparkSession, path) -> bool:
    """Whether some line of the files has an odd number of quotes, so that a quoted field goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def with_columns_present(df: DataFrame, wanted) -> DataFrame:
    """Exactly the wanted columns, by name; absent ones are null text."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in wanted]
    )


def union_all_files(frames) -> DataFrame:
    """Bag union by column name of scans with different headers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_csv_numbered(spark: SparkSession, path, **scan_options) -> DataFrame:
    """`scan_csv_text` plus `file` and the source `line` of every row (header = line 1)."""
    return with_source_line(scan_csv_text(spark, path, **scan_options))


def with_source_line(scanned: DataFrame, first_line: int = 2) -> DataFrame:
    """Add `file` and the source `line` to a file scan (header = line 1)."""
    names = scanned.columns
    located = scanned.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("_metadata.file_path").alias(FILE_COLUMN), F.col("_metadata.file_block_start").alias("_block"),
    )
    return number_lines(located, first_line)


def number_lines(located: DataFrame, first_line: int = 2, starts: DataFrame | None = None) -> DataFrame:
    """Number the rows of each file in file order, without bringing a file to one task.

    Spark reads a split in order, so the running id of a task orders the rows of a split and the
    split's start (`_block`) orders the splits of a file. The rows before a split come from a table
    of one row per split, `starts`; a caller may make it before and say how it is joined.
    """
    names = [c for c in located.columns if c not in (FILE_COLUMN, "_block")]
    tagged = located.withColumn("_id", F.monotonically_increasing_id())
    starts = split_starts(located) if starts is None else starts
    line = (F.col("_id") - F.col("_base") + F.col("_start") + first_line).alias(LINE_COLUMN)
    return tagged.join(starts, [FILE_COLUMN, "_block"]).select(*[F.col(f"`{c}`") for c in names], FILE_COLUMN, line)


def split_starts(located: DataFrame) -> DataFrame:
    """Per split: the running id of its first row, and the rows of its file before it."""
    tagged = located.withColumn("_id", F.monotonically_increasing_id())
    splits = tagged.groupBy(FILE_COLUMN, "_block").agg(F.min("_id").alias("_base"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(FILE_COLUMN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")


def scan_jdbc(spark: SparkSession, url: str, table_or_query: str, columns=None, split=None, fetch_rows: int = 1000, **options) -> DataFrame:
    """Database table or query. `split` = (column, lower, upper, parts) reads it in parallel ranges.

    Filters, column choice and aggregates over the result are pushed to the database by Spark.
    """
    source = table_or_query.strip()
    if source.lower().startswith("select"):
        source = f"({source}) q"
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, fetchsize=fetch_rows, **options)
    if split:
        column, lower, upper, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    df = reader.load()
    return df.select(*columns) if columns else df


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell grid: one row per filled cell."""
    return spark.read.schema("sheet string, row int, col int, value string").parquet(path)


def scan_merges(spark: SparkSession, path: str) -> DataFrame:
    """Merged ranges of a cell grid."""
    return spark.read.schema(
        "sheet string, min_row int, min_col int, max_row int, max_col int"
    ).parquet(path)


def scan_fee_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Fee rows: year, month name, fee."""
    return spark.read.schema("yr int, month_name string, fee decimal(18,2)").parquet(path)
