"""From documents to training sequences: five stages, each written as Parquet and read again as the next one's documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.decontaminate import contamination, text_mark
from tallyfold.llm.langid import identify_languages
from tallyfold.llm.linededup import dedup_lines
from tallyfold.llm.neardup import near_duplicates
from tallyfold.llm.packing import pack_sequences
from tallyfold.llm.tables import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _aside(docs: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """Columns called as an operator's results, under other names meanwhile."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those in which no language holds half of the text."""
    rows, back = _aside(docs, ("held_out", "lang_pred", "score", "n_langs"))
    found = identify_languages(rows).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return found.select(rows.columns).withColumnsRenamed(back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had text and loses all of it goes. n_chars follows the text."""
    rows, back = _aside(docs, ("n_lines", "n_dropped", "_drops", "_id", "_mark", "_m", "_d", "_lines"))
    found = dedup_lines(rows).where(~((F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    if "n_chars" in rows.columns:
        kind = rows.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(rows.columns).withColumnsRenamed(back)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; documents without words or id all stay.

    Of rows that repeat a doc_id one stays as well, unless they have no words.
    """
    groups = near_duplicates(docs)
    keepers = groups.where("kept and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_keeper")).distinct()
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    plain, back = _aside(docs, ("_words", "_first", "_keeper"))
    rows = plain.withColumn("_words", words)
    held = rows.where("_words").join(keepers, F.col("doc_id") == F.col("_keeper"), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    held = held.withColumn("_first", first).where("_first = 1")
    return held.select(plain.columns).unionByName(rows.where("not _words").select(plain.columns)).withColumnsRenamed(back)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by an item of the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark")).distinct()
    rows, back = _aside(docs, ("_id", "_mark"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_mark(F.col("text")).eqNullSafe(F.col("_mark")))
    return rows.join(found, same, "left_anti").withColumnsRenamed(back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return pack_sequences(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokens and language models have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
