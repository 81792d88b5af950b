"""Statement and list texts, as ordered lines for `sink_lines`."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import INSERT_BATCH_ROWS
from tallyfold.functions.literals import escape_quotes, row_literal
from tallyfold.operators.joins import lookup_join
from tallyfold.operators.numbering import batch_number
from tallyfold.session import constant_rows


def with_separator(lines: DataFrame, order: str, text: Column, sep: str, name: str = "line") -> DataFrame:
    """Trailing separator on every line but the last; `order` is unique.

    The last line is known from a one-row maximum, so no window has to see all lines.
    """
    last = lines.agg(F.max(order)).scalar()
    return lines.withColumn(name, F.concat(text, F.when(F.col(order) == last, "").otherwise(sep)))


def quoted_reference_list(occurrences: DataFrame) -> DataFrame:
    """`'id',` per distinct reference in code-point order; the last has no comma."""
    known = occurrences.where("reference is not null").select("reference")
    return with_separator(known, "reference", F.concat(F.lit("'"), F.col("reference"), F.lit("'")), ",")


def duplicate_reference_lines(occurrences: DataFrame, word: str = "occurrences") -> DataFrame:
    """`'id' : n occurrences` per repeated reference."""
    return occurrences.where("occurrences > 1").select(
        "reference", F.format_string(f"'%s' : %d {word}", "reference", "occurrences").alias("line")
    )


def decimal_array_literal(payments: DataFrame, head: str = "BigDecimal[] valeurs = {", tail: str = "};",
                          item: str = '    new BigDecimal("%s")') -> DataFrame:
    """Array-literal lines `(file, ord, line)` of the amounts of every file, in document order.

    `payments` is `(file, ord, amount text)`. The last amount of a file is known from a grouped maximum.
    """
    last = payments.groupBy("file").agg(F.max("ord").alias("_last"))
    items = lookup_join(payments, last, ["file"]).select(
        "file", F.col("ord").cast("int").alias("ord"),
        F.concat(F.format_string(item, "amount"), F.when(F.col("ord") < F.col("_last"), ",").otherwise("")).alias("line"),
    )
    ends = last.select("file", F.explode(F.array(
        F.struct(F.lit(-1).alias("ord"), F.lit(head).alias("line")),
        F.struct((F.col("_last") + 1).cast("int").alias("ord"), F.lit(tail).alias("line")),
    )).alias("e")).select("file", "e.*")
    return items.unionByName(ends)


def city_inserts(cities: DataFrame, table: str = "ville", sequence: str = "S_VILLE.nextval", stamp: str = "SYSDATE",
                 name: str = "VI_LIBELLE", zone: str = "VI_ZN_ID", status: str = "STATUT",
                 created_by: str = "USER_CREATE", changed_by: str = "USER_MODIF", closing: str = "COMMIT;") -> DataFrame:
    """`(ord, name, line)`: one INSERT per city with quotes doubled (ord 0), a blank line (1), the closing line (2)."""
    def text(column):
        return escape_quotes(F.coalesce(F.col(column), F.lit("")))

    statement = F.format_string(
        f"INSERT INTO {table} VALUES ({sequence}, '%s', %s, %s, '%s', '%s', {stamp}, {stamp});",
        text(name), F.col(zone).cast("string"), F.col(status).cast("string"), text(created_by), text(changed_by),
    )
    rows = cities.select(F.lit(0).alias("ord"), F.col(name).alias("name"), statement.alias("line"))
    end = constant_rows(cities.sparkSession, "ord int, name string, line string", [(1, None, ""), (2, None, closing)])
    return rows.unionByName(end)


def batch_inserts(df: DataFrame, table: str, position: str, columns=None, size: int = INSERT_BATCH_ROWS) -> DataFrame:
    """One multi-row INSERT text per `size` rows in position order: table_name, batch, n_rows, line."""
    names = columns or df.columns
    rows = df.select(F.lit(table).alias("table_name"), F.col(position).alias("_pos"), row_literal(df, names).alias("_row"))
    batches = batch_number(rows, ["table_name"], "_pos", size)
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_row")))
    body = F.array_join(F.transform(ordered, lambda r: r["_row"]), ",\n")
    head = f"INSERT INTO {table} ({', '.join(names)}) VALUES\n"
    return batches.groupBy("table_name", "batch").agg(
        F.count("*").alias("n_rows"), F.concat(F.lit(head), body, F.lit(";")).alias("line")
    )
