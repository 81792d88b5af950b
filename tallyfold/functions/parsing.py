"""Column expressions that turn text fields into numbers, timestamps and codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.fixed_values import BLANKS, PARTNER_STATUS_CODES, TIMESTAMP_LAYOUTS

# Blanks around a number are accepted here and dropped by the cast.
_PLAIN_DECIMAL = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?\s*\z"
# Wide enough for amounts and rates as they are written: eighteen digits before the point, ten after it.
NUMBER_TYPE = "decimal(28,10)"
_DIGITS = r"^[0-9]+\z"
_ACCOUNT = r"^[0-9]*[1-9][0-9]*\z"


def strip(text: Column) -> Column:
    """Trim every ASCII blank, not just spaces."""
    return F.trim(text, F.lit(BLANKS))


def plain_number(text: Column, dtype: str = NUMBER_TYPE) -> Column:
    """Number written with a dot, with or without exponent (`.5`, `5.`, `1e3`); anything else is null. The comma is not a decimal sign here."""
    return F.when(text.rlike(_PLAIN_DECIMAL), text.try_cast(dtype))


def locale_number(text: Column, dtype: str = NUMBER_TYPE) -> Column:
    """Number written with a comma or a dot; anything else is null."""
    return plain_number(F.replace(text, F.lit(","), F.lit(".")), dtype)


def multi_format_timestamp(text: Column, layouts=TIMESTAMP_LAYOUTS) -> Column:
    """Timestamp without time zone from the layout that fits the whole text; null for none, or for no real date.

    The fields are put in ISO order and cast, which is much cheaper than formatters that fail on most rows
    and does not depend on the session time zone.
    """
    iso = F.lit(None).cast("string")
    for pattern, order in reversed(layouts):
        iso = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(iso)
    return iso.try_cast("timestamp_ntz")


def map_code(code: Column, mapping=PARTNER_STATUS_CODES) -> Column:
    """Mapped code, or the code itself when the map does not hold it."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def is_numeric_id(text: Column) -> Column:
    """True for a non-empty run of ASCII digits; null and everything else is false."""
    return F.coalesce(text.rlike(_DIGITS), F.lit(False))


def is_numeric_account(text: Column) -> Column:
    """True for digits with at least one that is not zero."""
    return F.coalesce(text.rlike(_ACCOUNT), F.lit(False))


def is_present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""
