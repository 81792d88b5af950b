"""Writers. Every writer keeps the frame's partitions; nothing passes through the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.joins import lookup_join


# Blanks at the ends of a field are data.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def sink_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def sink_csv_quoted(df: DataFrame, path: str, mode: str = "error") -> None:
    """Every field quoted, `;` between fields."""
    df.write.mode(mode).options(**_CSV, sep=";", quoteAll=True).csv(path)


def sink_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, nulls written, non-ASCII characters kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def sink_lines(lines: DataFrame, path: str, order, line: str = "line", mode: str = "error") -> None:
    """Text lines in a total order: the part files, read in name order, are the document."""
    lines.orderBy(*order).select(line).write.mode(mode).text(path)


def sink_sections(sections: DataFrame, path: str, section: str = "sheet", mode: str = "error") -> None:
    """One folder per named section."""
    sections.write.mode(mode).partitionBy(section).options(**_CSV).csv(path)


def sink_append(df: DataFrame, path: str) -> None:
    """Append to a Parquet store."""
    df.write.mode("append").parquet(path)


def sink_append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 1000, **options) -> None:
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, batchsize=batch_rows, **options).save()


def json_document_lines(entries: DataFrame, key: str, body: str) -> DataFrame:
    """Lines of one JSON object per section: `{`, `"key": body,` …, `}`, ready for `sink_lines`.

    Columns out: section, part (0 opening, 1 entry, 2 closing), key, line. The last entry of a section is
    found by a grouped maximum, not by a window over the whole section.
    """
    last = entries.groupBy("section").agg(F.max(key).alias("_last"))
    comma = F.when(F.col(key) < F.col("_last"), ",").otherwise("")
    quoted_key = F.to_json(F.struct(F.col(key).alias("k")))
    quoted_key = F.substr(quoted_key, F.lit(6), F.length(quoted_key) - 6)
    rows = lookup_join(entries, last, ["section"]).select(
        "section", F.lit(1).alias("part"), F.col(key).alias("key"),
        F.concat(F.lit("  "), quoted_key, F.lit(": "), F.col(body), comma).alias("line"),
    )
    ends = last.select("section", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("{").alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("").alias("key"), F.lit("}").alias("line")),
    )).alias("e")).select("section", "e.*")
    return rows.unionByName(ends)
