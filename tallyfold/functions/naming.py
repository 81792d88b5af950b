"""Names, paths and sizes as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import FILE_CATEGORIES, FILENAME_FORBIDDEN, OTHER_CATEGORY
from tallyfold.functions.parsing import strip
from tallyfold.session import constant_rows


def safe_filename(title: Column, forbidden: str = FILENAME_FORBIDDEN) -> Column:
    return F.translate(strip(title), forbidden, "_" * len(forbidden))


def safe_name(name: Column, prefix: str = "", suffix: str = "") -> Column:
    """Letters, digits, space, `-` and `_` only, between an optional prefix and suffix."""
    kept = strip(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    return F.concat(F.lit(prefix), kept, F.lit(suffix))


def slug_key(text: Column) -> Column:
    """Lower case; blank, `-` and `/` become `_`; quotes vanish; no `_` at either end."""
    return F.trim(F.translate(F.lower(text), " -/'\"", "___"), F.lit("_"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Last suffix with its dot, lower case; empty for names without one, such as `.profile`."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*([.][^./]*)\z", 1))


def raw_extension(path: Column) -> Column:
    """Text after the last dot, as written; the whole name when there is no dot."""
    return F.substring_index(base_name(path), ".", -1)


def path_parts(path: Column) -> Column:
    """Directories and file name of a path, without empty parts."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def file_category(files: DataFrame, path: str = "path", rules=FILE_CATEGORIES, default=OTHER_CATEGORY) -> DataFrame:
    """Add `category`. The rule table is a constant of a few dozen rows, hence the broadcast."""
    table = constant_rows(files.sparkSession, "_ext string, category string", rules)
    tagged = files.withColumn("_ext", file_extension(F.col(path)))
    joined = tagged.join(F.broadcast(table), "_ext", "left").drop("_ext")
    return joined.withColumn("category", F.coalesce("category", F.lit(default)))


def bytes_to_mb(size: Column) -> Column:
    """Exact mebibytes: 2**-20 has twenty decimal digits."""
    return size.cast("decimal(18,0)") * F.lit("0.00000095367431640625").cast("decimal(20,20)")


def mb_text(size: Column) -> Column:
    """Mebibytes with two decimals, ties to even on the exact value."""
    return F.bround(bytes_to_mb(size), 2).cast("decimal(20,2)").cast("string")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
