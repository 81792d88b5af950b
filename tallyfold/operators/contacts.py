"""Customer routing and the change tables made from it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import SEGMENT_CODES
from tallyfold.functions.parsing import is_numeric_id, is_present
from tallyfold.session import constant_rows


def split_numeric_ids(df: DataFrame, column: str) -> DataFrame:
    """Add `route`: numeric or other. Written with `partitionBy('route')`, both outputs take one pass."""
    return df.withColumn("route", F.when(is_numeric_id(F.col(column)), "numeric").otherwise("other"))


def route_screening(df: DataFrame, status_a: str, status_b: str, risk: str) -> DataFrame:
    """One row per route a customer is on: A, B, both of them, or NONE."""
    in_a = F.coalesce(F.col(status_a) == risk, F.lit(False))
    in_b = F.coalesce(F.col(status_b) == risk, F.lit(False))
    routes = F.array(F.when(in_a, "A"), F.when(in_b, "B"), F.when(~in_a & ~in_b, "NONE"))
    return df.withColumn("route", F.explode(F.filter(routes, lambda r: r.isNotNull())))


def screening_overlap(df: DataFrame, status_a: str, status_b: str, risk: str) -> DataFrame:
    """Rows per condition, and in both."""
    in_a, in_b = F.col(status_a) == risk, F.col(status_b) == risk
    return df.agg(
        F.count_if(in_a).alias("in_a"), F.count_if(in_b).alias("in_b"), F.count_if(in_a & in_b).alias("in_both")
    )


def filter_key_present(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_present(F.col(column)))


def contact_changes(df: DataFrame, key: str = "id", first: str = "telephone1", second: str = "telephone2",
                    table: str = "SENDER", key_column: str = "SEN_ID",
                    columns=("SEN_PHONE_NUMBER1", "SEN_PHONE_NUMBER2")) -> DataFrame:
    """Change table (key, phone1, phone2 or null) with the UPDATE text as one column."""
    one, two = F.coalesce(F.col(first), F.lit("")), F.nullif(F.col(second), F.lit(""))
    second_part = F.coalesce(F.concat(F.lit(f", {columns[1]}='"), two, F.lit("'")), F.lit(""))
    statement = F.concat(
        F.lit(f"UPDATE {table} SET {columns[0]}='"), one, F.lit("'"), second_part,
        F.lit(f" WHERE {key_column}="), F.col(key).cast("string"), F.lit(";"),
    )
    return df.select(
        F.col(key).alias("id"), one.alias("phone1"), two.alias("phone2"), statement.alias("line")
    )


def segment_changes(routed: DataFrame, key: str, codes=SEGMENT_CODES, table: str = "SENDER",
                    columns=("DATA2", "DATA3"), key_column: str = "SEN_ID") -> DataFrame:
    """Change table (id, route, code1, code2) with the UPDATE text; rows without key are left out."""
    rules = constant_rows(routed.sparkSession, "route string, code1 string, code2 string", codes)
    coded = filter_key_present(routed, key).join(F.broadcast(rules), "route")
    statement = F.format_string(
        f'UPDATE {table} SET {columns[0]}="%s", {columns[1]}="%s" WHERE {key_column} = %s;', "code1", "code2", key
    )
    return coded.select(F.col(key).alias("id"), "route", "code1", "code2", statement.alias("line"))
