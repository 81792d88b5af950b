"""Phone number expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.parsing import strip

# Written form -> position (1-based) where the national number starts.
_WRITTEN_FORMS = (
    (r"(?s)^0[1-9].{8}\z", 2),
    (r"(?s)^[1-9].{8}\z", 1),
    (r"(?s)^0033.{9}\z", 5),
    (r"(?s)^00330[1-9].{8}\z", 6),
    (r"(?s)^[+]33.{9}\z", 4),
)
_VALID = r"(?s)^33[1-9].{8}\z"


def normalise_phone(phone: Column) -> Column:
    """`33` + national number for the five known written forms, else the trimmed text; null stays null."""
    bare = strip(phone)
    expr = bare
    for pattern, start in reversed(_WRITTEN_FORMS):
        national = F.concat(F.lit("33"), F.substr(bare, F.lit(start)))
        expr = F.when(bare.rlike(pattern), national).otherwise(expr)
    return expr


def phone_is_valid(phone: Column) -> Column:
    return F.coalesce(phone.rlike(_VALID), F.lit(False))


def normalise_phones(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: normalise_phone(F.col(c)) for c in columns})


def phone_pick_valid(df: DataFrame, first: str = "telephone1", second: str = "telephone2") -> DataFrame:
    """Rows with a valid number in either column; the first column ends up holding a valid one."""
    first_ok, second_ok = phone_is_valid(F.col(first)), phone_is_valid(F.col(second))
    return df.where(first_ok | second_ok).withColumn(
        first, F.when(first_ok, F.col(first)).otherwise(F.col(second))
    )
