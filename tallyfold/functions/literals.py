"""SQL literals and statement text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    """Literal of a value by its type; null becomes the word NULL."""
    if isinstance(dtype, T.StringType):
        text = quoted(escape_quotes(value))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = quoted(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))
    elif isinstance(dtype, T.DateType):
        text = quoted(value.cast("string"))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, "TRUE").when(~value, "FALSE")
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("'\\x"), F.lower(F.hex(value)), F.lit("'"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def row_literal(df: DataFrame, columns=None) -> Column:
    """`(v1, v2, …)` over the given columns of a frame, typed by its schema."""
    names = columns or df.columns
    return F.concat(
        F.lit("("),
        F.concat_ws(", ", *[sql_literal(F.col(f"`{c}`"), df.schema[c].dataType) for c in names]),
        F.lit(")"),
    )
