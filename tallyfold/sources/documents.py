"""Text corpora, name lists, nested JSON and payment messages as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.parsing import strip

ENTRY_SCHEMA = (
    "struct<ligne: int, comptes: array<struct<numero: string, sens: string, intitule: string, "
    "montant: string, formule: string>>, libelle: string>"
)
LEDGER_SCHEMA = f"map<string, array<{ENTRY_SCHEMA}>>"


def located_at() -> Column:
    """Path of the scanned file; Spark reports it as an escaped URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def scan_corpus(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Files below a folder: path, size, modification time, text. One file is one row."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(
        located_at().alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def scan_inventory(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Files below a folder without their contents: path, size, modification time. No file is opened."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, **({"pathGlobFilter": glob} if glob else {})).load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def scan_payment_folder(spark: SparkSession, path) -> DataFrame:
    """Files named `.xml` in any letter case: file, value."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.where(F.lower(F.col("_metadata.file_name")).endswith(".xml")).select(
        located_at().alias("file"), "value"
    )


def scan_payment_parts(spark: SparkSession, path) -> DataFrame:
    """Payment messages of any size in pieces: file, block, at (both for the order), value.

    Files are cut behind every payment by the text reader itself, in splits, so no row holds a message. A message whose tags carry a
    prefix has no such place and comes as one piece.
    """
    lines = spark.read.option("lineSep", "</CdtTrfTxInf>").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def scan_name_list(spark: SparkSession, path) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("name")).where("name <> ''")


def scan_json_nested(spark: SparkSession, path, schema: str = LEDGER_SCHEMA, one_per_file: bool = True) -> DataFrame:
    """Nested JSON documents with an explicit schema, one per file or one per line."""
    text = spark.read.text(path, wholetext=one_per_file)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("doc")
    )
