"""Quoted CSV read in splits: records with line breaks inside quotes are found although no task reads a whole file.

Whether a line begins inside a quoted field depends on all lines before it. Each task walks its split under both
assumptions at once; what a split does to either is one row, and a running composition of these rows over the splits of
a file tells which assumption held for each. Records of one line are parsed where they are; only lines of records with
breaks are brought together.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators.joins import lookup_join
from tallyfold.sources.tables import FILE_COLUMN, LINE_COLUMN, with_columns_present

_NOTED = "seq long, q0 boolean, q1 boolean, e0 boolean, e1 boolean, r0 long, r1 long, s0 long, s1 long"


def _line_steps(sep: str) -> tuple[str, str]:
    """Patterns of lines that end inside quotes, for a line that begins outside and for one that begins inside.

    A quote opens a field only as its first character, two quotes inside are one, and behind a closing quote whatever
    stands before the next separator belongs to the field.
    """
    s = "\\" + sep
    quoted = '(?:[^"]|"")*'
    plain, closed = f'[^"{s}][^{s}]*', f'"{quoted}"(?:[^"{s}][^{s}]*)?'
    field = f"(?:{closed}|{plain})?"
    return f'^(?:{field}{s})*"{quoted}$', f'^{quoted}$|^{quoted}"(?:[^"{s}][^{s}]*)?{s}(?:{field}{s})*"{quoted}$'


def _states(ends: tuple[np.ndarray, np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins and ends (inside quotes or not), from where the first begins.

    A line that ends alike from both sides fixes the state; one that does not keeps or turns it. So a line's end is that of the last
    fixing line before it, turned as often as a turning line has stood between.
    """
    from0, from1 = ends
    n = len(from0)
    fixing, turning = from0 == from1, from0 & ~from1
    turns = np.cumsum(turning)
    last = np.maximum.accumulate(np.where(fixing, np.arange(n), -1))
    known = np.where(last >= 0, from0[np.maximum(last, 0)], bool(begin))
    since = turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)
    end = known ^ (since % 2 == 1)
    return np.concatenate([[bool(begin)], end[:-1]]), end


def _annotated(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with, under each assumption (0: the split begins outside quotes, 1: inside): whether the line begins (q) and ends (e)
    inside, records begun in the split before it (r), and the line on which its record began (s, -1 for an earlier split)."""
    outside, inside = _line_steps(sep)

    def run(batches):
        held = None  # (file, block), lines so far, and for both assumptions: state, records, line of the last begin
        for batch in batches:
            files, blocks = batch.column("file"), np.asarray(batch.column("block"))
            new = np.ones(len(blocks), bool)
            new[1:] = (blocks[1:] != blocks[:-1]) | np.asarray(pc.not_equal(files[1:], files[:-1]), bool) if len(blocks) > 1 else new[1:]
            cuts = [*np.flatnonzero(new).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                here = (files[low].as_py(), int(blocks[low]))
                if held is None or held[0] != here:
                    held = (here, 0, [[0, 0, -1], [1, 0, -1]])
                _, before, sides = held
                text = part.column("value")
                ends = tuple(np.asarray(pc.match_substring_regex(text, p), bool) for p in (outside, inside))
                blank = np.asarray(pc.equal(pc.utf8_length(text), 0), bool)
                seq = before + np.arange(high - low)
                out = []
                for side in sides:
                    begins, stops = _states(ends, side[0])
                    opens = ~begins & ~blank
                    count = np.cumsum(opens)
                    start = np.maximum.accumulate(np.where(~begins, seq, -1))
                    start = np.where(start >= 0, start, side[2])
                    out.append((begins, stops, side[1] + count - opens, start))
                    side[:] = [int(stops[-1]), side[1] + int(count[-1]), int(start[-1])]
                held = (here, before + high - low, sides)
                (q0, e0, r0, s0), (q1, e1, r1, s1) = out
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *map(pa.array, (seq, q0, q1, e0, e1, r0, r1, s0, s1))],
                    names=[*part.schema.names, "seq", "q0", "q1", "e0", "e1", "r0", "r1", "s0", "s1"])

    return lines.mapInArrow(run, f"file string, block long, value string, {_NOTED}")


def _split_starts(noted: DataFrame) -> DataFrame:
    """Per split: whether it begins inside quotes, lines and records before it, and the line on which an open record began."""
    splits = noted.groupBy("file", "block").agg(
        F.count("*").alias("lines"), F.max_by(F.struct("e0", "e1", (F.col("r0") + (~F.col("q0") & F.col("solid")).cast("int")).alias("n0"),
                                                       (F.col("r1") + (~F.col("q1") & F.col("solid")).cast("int")).alias("n1"), "s0", "s1"), "seq").alias("z"))
    here = Window.partitionBy("file").orderBy("block")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turned = F.col("z.e0") == F.col("z.e1"), F.col("z.e0") & ~F.col("z.e1")
    marked = splits.withColumn("turns", F.sum(turned.cast("int")).over(here))
    anchor = F.last(F.when(fixed, F.struct(F.col("z.e0").alias("e"), "turns")), ignorenulls=True).over(past)
    marked = marked.withColumn("anchor", anchor).withColumn("before", F.coalesce(F.sum(turned.cast("int")).over(past), F.lit(0)))
    inside = F.coalesce(F.col("anchor.e"), F.lit(False)) != ((F.col("before") - F.coalesce("anchor.turns", F.lit(0))) % 2 == 1)
    known = marked.withColumn("inside", inside)
    records = F.when(F.col("inside"), F.col("z.n1")).otherwise(F.col("z.n0"))
    known = known.withColumn("first_line", F.coalesce(F.sum("lines").over(past), F.lit(0))).withColumn("first_record", F.coalesce(F.sum(records).over(past), F.lit(0)))
    own = F.when(F.col("inside"), F.col("z.s1")).otherwise(F.col("z.s0"))
    begun = F.last(F.when(own >= 0, F.col("first_line") + own), ignorenulls=True).over(past)
    return known.withColumn("open_line", begun).select("file", "block", "inside", "first_line", "first_record", "open_line")


def scan_split_csv(spark: SparkSession, path, wanted=None, sep: str = ",", columns=None) -> DataFrame:
    """Header CSV with every column as text, plus `file` and `line` (first record behind the header: 2), as
    `scan_csv_numbered` gives them, but with large files split however their records break.

    Lines end with a newline, with or without carriage return before it; inside quotes both become a newline. All files have one header; `columns` names its fields
    (default: read from the files). A file with another header fails. Empty lines are no records. A record whose quotes never close takes
    the rest of its file with it, as in the reader that streams a file; such a file does not fit one task.
    """
    names = list(columns or spark.read.options(header=True, sep=sep, escape='"', multiLine=True, inferSchema=False).csv(path).columns)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    noted = _annotated(lines, sep).withColumn("solid", F.col("value") != "")
    known = lookup_join(noted, _split_starts(noted), ["file", "block"])
    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    start = pick("s0", "s1")
    placed = known.select(
        "file", "value", "solid", (F.col("first_line") + F.col("seq")).alias("at"), pick("q0", "q1").alias("begins"), pick("e0", "e1").alias("ends"),
        (F.col("first_record") + pick("r0", "r1")).alias("record"), F.when(start >= 0, F.col("first_line") + start).otherwise(F.col("open_line")).alias("start"))
    alone = placed.where(~F.col("begins") & ~F.col("ends") & F.col("solid")).select("file", "record", "value")
    broken = placed.where(F.col("begins") | F.col("ends")).groupBy("file", "start").agg(
        F.min(F.when(~F.col("begins"), F.col("record"))).alias("record"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    records = alone.unionByName(broken.select("file", "record", "value"))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = records.withColumn("v", F.from_csv("value", F.lit(schema), {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}))
    same = F.array(*[F.coalesce(F.col(f"v.`{n}`"), F.lit("")) for n in names]) == F.array(*[F.lit(n) for n in names])
    checked = parsed.where(F.when(F.col("record") == 0, F.when(same, F.lit(False)).otherwise(
        F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean"))).otherwise(True))
    rows = checked.select(*[F.col(f"v.`{n}`").alias(n) for n in names], F.col("file").alias(FILE_COLUMN), (F.col("record") + 1).alias(LINE_COLUMN))
    return with_columns_present(rows, [*wanted, FILE_COLUMN, LINE_COLUMN]) if wanted else rows


def number_on(rows: DataFrame, group: str) -> DataFrame:
    """Rows of `scan_split_csv` with `line` counted on through the files of one `group`, in the order of the files' names.

    Part files of one table each have a header; the first record of the first file keeps line 2, as if all were one file.
    """
    files = rows.groupBy(group, FILE_COLUMN).agg((F.max(LINE_COLUMN) - 1).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy(FILE_COLUMN).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(FILE_COLUMN, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return lookup_join(rows, starts, [FILE_COLUMN]).withColumn(LINE_COLUMN, F.col(LINE_COLUMN) + F.col("_start")).drop("_start")
